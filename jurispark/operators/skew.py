"""Joins and running totals that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize, materialize_with

# A model table is broadcast only up to this many rows (tens of MB as a hash table).
BROADCAST_ROWS = 500_000
# A key is cut into slices of about this many rows ...
ROWS_PER_SLICE = 1_000_000
# ... and at most this many keys count as hot, which bounds the hot-key broadcast.
MAX_HOT_KEYS = 1_000
# A bucket of running totals with more rows is cut into this many equal spans of its values.
SPANS = 1_024


def weighted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    weight: str,
    salt_from: Sequence[str],
    right_rows: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join ``left`` with ``right`` (unique on ``on``), slicing keys with many left rows.

    ``right[weight]`` is the number of left rows of each key (or an upper bound).
    With a counted, small ``right`` this is one broadcast join.  Otherwise keys
    heavier than max(ROWS_PER_SLICE, total / MAX_HOT_KEYS) are cut into slices:
    at most MAX_HOT_KEYS keys can be that heavy, so the table of hot keys is
    bounded and safe to broadcast.  ``weight`` is dropped from the result.
    """
    keys = list(on)
    if right_rows is not None and right_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    total = right.agg(F.sum(weight)).scalar()
    slice_rows = F.greatest(F.lit(float(ROWS_PER_SLICE)), total / F.lit(float(MAX_HOT_KEYS)))
    sliced = right.withColumn(
        "_slices", F.greatest(F.lit(1), F.ceil(F.col(weight) / slice_rows)).cast("int")
    )
    hot = sliced.where("_slices > 1").select(*keys, "_slices")
    salted_left = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.pmod(F.xxhash64(*salt_from), F.coalesce("_slices", F.lit(1))).cast("int"),
        )
        .drop("_slices")
    )
    salted_right = sliced.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    ).drop("_slices", weight)
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def counted_join(
    left: DataFrame, right: DataFrame, on: str, salt_from: Sequence[str], how: str = "inner"
) -> DataFrame:
    """``weighted_join`` with a ``right`` side (unique on ``on``) whose key weights are not known.

    A ``right`` too large to broadcast has the left rows of its keys counted first, so only keys
    that are frequent are sliced and copied.
    """
    n = right.count()
    if n <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("_weight"))
    weighted = materialize(right.join(counts, on, "left").na.fill(0, ["_weight"]))
    return weighted_join(left, weighted, [on], "_weight", salt_from, n, how)


def cut_buckets(
    df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], bucket: Column
) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``_bucket``, sums of ``measures`` per keys and ``_bucket``): no bucket too large.

    A bucket is an array that sorts by its entries.  One with more than max(ROWS_PER_SLICE,
    total / MAX_HOT_KEYS) rows gets one more entry: which of SPANS equal spans between its
    smallest and its largest value a row lies in.  That follows the order, and the two extremes
    part, so every round tells values apart that the last one did not.  At most MAX_HOT_KEYS
    buckets can be that large, which bounds their broadcast.  ``order`` is a finite number, and so
    is the distance of two values in one bucket.
    """
    parts = df.withColumn("_bucket", F.array(bucket.cast("int")))
    while True:
        found = parts.groupBy(*keys, "_bucket").agg(
            *[F.sum(m).alias(m) for m in measures],
            F.count(F.lit(1)).alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high"),
        )
        sums, seen = materialize_with(
            found, F.sum("_n").alias("n"), F.max(F.when(F.col("_low") < F.col("_high"), F.col("_n"))).alias("most")
        )
        limit = max(ROWS_PER_SLICE, (seen["n"] or 0) / MAX_HOT_KEYS)
        if (seen["most"] or 0) <= limit:
            return parts, sums.drop("_n", "_low", "_high")
        large = sums.where((F.col("_n") > limit) & (F.col("_low") < F.col("_high")))
        share = (F.col(order) - F.col("_low")) / (F.col("_high") - F.col("_low"))
        span = F.least(F.floor(share * SPANS), F.lit(SPANS - 1)).cast("int")
        parts = (
            parts.join(F.broadcast(large.select(*keys, "_bucket", "_low", "_high")), [*keys, "_bucket"], "left")
            .withColumn("_bucket", F.when(F.col("_low").isNull(), F.col("_bucket")).otherwise(
                F.concat("_bucket", F.array(span))))
            .select(*parts.columns)
        )


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], bucket: Column
) -> DataFrame:
    """Add ``<m>_before``: the sum of ``m`` over rows of the same key with a smaller ``order``.

    ``df`` has one row per (keys, order).  ``bucket`` must follow the order.  Each
    task sorts one bucket of one key; the carry between buckets comes from a
    per-bucket aggregate, so a key with most of the rows is spread over many tasks.
    Buckets are counted, and those that hold too many rows are cut by ``cut_buckets``.
    """
    keys = list(keys)
    parts, sums = cut_buckets(df, keys, order, measures, bucket)
    before = (W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(*before)
    carry = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(m).over(across), F.lit(0)).alias(f"_carry_{m}") for m in measures],
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(*before)
    # Never broadcast: a small file of carries may be hundreds of MB in memory, and the windows
    # below need rows dealt by these keys anyway.
    out = parts.join(carry.hint("merge"), [*keys, "_bucket"])
    for m in measures:
        out = out.withColumn(
            f"{m}_before", F.coalesce(F.sum(m).over(inside), F.lit(0)) + F.col(f"_carry_{m}")
        )
    return out.drop("_bucket", *[f"_carry_{m}" for m in measures])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str
) -> DataFrame:
    """1-based position of each row inside its key, without one task per key.

    ``bucket`` must follow ``order``; rows are numbered inside (key, bucket) and
    shifted by the row counts of the earlier buckets.
    """
    keys = list(keys)
    parts = df.withColumn("_bucket", bucket)
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = (
        parts.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_shift"))
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        parts.join(shift, [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(inside) + F.col("_shift"))
        .drop("_bucket", "_shift")
    )
