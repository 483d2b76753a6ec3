"""Vectors packed into blocks, and the pairing of query blocks with all blocks.

A search of a stated set of queries against all rows is a set of (rows, queries) block pairs.
Rows are packed partition by partition, without a shuffle; the pairing is an equi-join on the
group of a row block, to which every query block is copied once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize

ROWS = 16_384  # vectors per block
QUERIES = 512  # queries per block
BLOCKS_PER_GROUP = 4
PACKED = "block long, n int, ids binary, data binary"


def usable(
    vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding", allow_zero: bool = False
) -> DataFrame:
    """(id, v): rows with an id and a vector of finite numbers, as doubles, of one length.

    Vectors of other lengths than the most frequent one (the smallest of those, if tied) have
    no inner product with the rest and take no part; zero vectors only if ``allow_zero``.
    """
    v = F.col("v")
    fine = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    rows = vectors.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
    if not allow_zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("v") == (best[0]["size"] if best else 0))


def pack(rows: DataFrame, dtype: str, size: int) -> DataFrame:
    """(block, n, ids, data): rows (id, v) of a partition in runs of up to ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []
        waiting, made = 0, 0
        part = TaskContext.get().partitionId()

        def flush(k: int) -> pa.RecordBatch:
            nonlocal ids, data, waiting, made
            i, d = np.concatenate(ids), np.concatenate(data)
            ids, data, waiting = [i[k:]], [d[k:]], len(i) - k
            made += 1
            values = [(part << 32) + made, k, i[:k].tobytes(), d[:k].astype(dtype).tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(values, kinds, strict=True)],
                ["block", "n", "ids", "data"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            ids.append(batch.column("id").to_numpy())
            data.append(flat.reshape(batch.num_rows, -1))
            waiting += batch.num_rows
            while waiting >= size:
                yield flush(size)
        if waiting:
            yield flush(waiting)

    return materialize(rows.mapInArrow(run, PACKED))


def unpack(ids: bytes, data: bytes, n: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, dtype).reshape(n, -1)


def pairs(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Every (row block, query block): columns of ``blocks``, and those of ``queries`` with q_.

    Each pair is one row; those of a row block follow one another in a task.
    """
    groups = max(1, -(-blocks.count() // BLOCKS_PER_GROUP))
    copies = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    joined = dealt.hint("shuffle_hash").join(copies, "group").drop("group")
    # One pair is a large piece of work: spread pairs over the tasks one by one.
    return joined.repartition(F.col("block"), F.col("q_block")).sortWithinPartitions("block", "q_block")


def nearest(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The ``k`` rows (query_id, vec_id, score) of each query with the largest score, ranked."""
    w = W.partitionBy("query_id").orderBy(score.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
