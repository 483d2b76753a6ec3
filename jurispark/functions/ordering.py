"""Order keys: reproducible shuffles and order-preserving buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32 buckets per doubling of the magnitude; the offset keeps the code positive
# down to the smallest subnormal double (log2 = -1074).
BUCKETS_PER_OCTAVE = 32
BUCKET_OFFSET = 40_000


def shuffle_key(seed: int, row_id: Column) -> Column:
    """Pseudo-random order key of a row, the same in every engine and every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"))


def shuffle_bucket(key: Column, width: int = 3) -> Column:
    """Leading hex digits of a shuffle key: 16**width buckets in key order, even in size."""
    return F.substring(key, 1, width)


def value_bucket(value: Column) -> Column:
    """Integer bucket of a number such that a <= b implies bucket(a) <= bucket(b).

    It is a function of the value alone, so no sampling pass is needed and a
    recomputed task always lands in the same bucket.
    """
    magnitude = F.floor(F.log2(F.abs(value)) * BUCKETS_PER_OCTAVE) + BUCKET_OFFSET
    return (
        F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0)).cast("int")
    )


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for reports; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
