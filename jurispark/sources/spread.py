"""Use all cores on inputs that come as a few large row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an input that is read in fewer splits than there are cores out to all cores.

    A file with one row group is one split, whatever its size.  An input with more splits than
    cores is read as it is split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key``, over a fixed number of partitions.

    For rows that are small but cost much work: adaptive execution would put them into a few tasks
    by their bytes.
    """
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)
