"""Intermediate tables on shared storage.

Iterative fits cut their lineage by writing a table below the folder the cluster
names in ``spark.checkpoint.dir``.  A table (unlike a cached block) survives the
loss of an executor, and its files carry sizes, so later joins are planned from
real statistics.  All tables of an application lie in one folder named after it, which
can be removed when the application is done.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

# Spark's setting by which the shuffle files of a query go when it ends, and who asked for it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _asked = threading.Lock(), {}


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only for a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="jurispark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path below the application's scratch folder."""
    return f"{scratch_root(spark)}/jurispark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back, as ``schema`` if given."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def materialize_with(df: DataFrame, *sums: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates over the rows taken in the same pass."""
    seen = Observation()
    table = materialize(df.observe(seen, *sums))
    return table, seen.get


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that ``materialize`` wrote and nothing reads any more."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        own = f"/jurispark/{spark.sparkContext.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a written table go when it is written, not when the driver's JVM next tidies up."""
    with _lock:
        n, before = _asked.get(spark, (0, None))
        if not n:
            before = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _asked[spark] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _asked.pop(spark)
            if n > 1:
                _asked[spark] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)
