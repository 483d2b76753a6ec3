"""Ranks of feature values.

All ranks come from a ladder: the distinct values of a feature with their counts.
Equal values (all the zeros, above all) are one ladder row, and running totals over
a ladder are computed bucket by bucket, so a feature with most of the rows is not
sorted by a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import value_bucket
from ..sources.scratch import materialize
from .skew import running_totals, weighted_join


def value_ladder(cells: DataFrame, stats: DataFrame, n: float, sy: float) -> DataFrame:
    """(feature, value, cnt, sy): distinct values, their row counts and label sums.

    ``cells`` is (feature, value, y) without zeros; the zero row of each feature
    follows from ``stats`` (feature, nnz, sy) and the totals.
    """
    listed = cells.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("y").alias("sy")
    )
    zeros = stats.select(
        "feature",
        F.lit(0.0).alias("value"),
        (F.lit(int(n)) - F.col("nnz")).alias("cnt"),
        (F.lit(sy) - F.col("sy")).alias("sy"),
    ).where("cnt > 0")
    return listed.unionByName(zeros)


def with_rank(ladder: DataFrame, value: str = "value", key: str = "feature") -> DataFrame:
    """Add ``rank``: the mean position (from 1) of the rows that share the value.

    The ladder is written first: the running totals read it twice, once for the sums
    per bucket and once for the rows.
    """
    written = materialize(ladder)
    out = running_totals(written, [key], value, ["cnt"], value_bucket(F.col(value)))
    return out.withColumn("rank", F.col("cnt_before") + (F.col("cnt") + 1) / 2.0).drop("cnt_before")


def gini_rank(rank, n: float, nu: float):
    """Descending rank to the power nu - 1."""
    return F.pow(F.lit(n + 1.0) - rank, F.lit(nu - 1.0))


def cell_ranks(cells: DataFrame, ranked: DataFrame, n_values: int | None = None) -> DataFrame:
    """Put ladder columns back on the cells that hold the value."""
    return weighted_join(
        cells, ranked, ["feature", "value"], "cnt", ["id"], right_rows=n_values
    )


def ladder_powers(ranked: DataFrame, n: float, nu: float) -> DataFrame:
    """Ladder rows with what ranking a new value needs: cnt, ``lo`` and ``hi``.

    Adding one value below a ladder value leaves its descending rank d0 alone, adding
    one above raises it by 1; ``hi`` and ``lo`` are the sums of both powers.
    """
    d0 = F.lit(n + 1.0) - F.col("rank")
    p = F.lit(nu - 1.0)
    return ranked.select(
        "feature",
        "value",
        "cnt",
        (F.col("cnt") * F.pow(d0, p)).alias("hi"),
        (F.col("cnt") * F.pow(d0 + 1.0, p)).alias("lo"),
    )


def new_value_ranks(
    powers: DataFrame, values: DataFrame, n: float, nu: float, center: bool = True
) -> DataFrame:
    """(feature, value, r): Gini rank each new value gets when it joins the train values alone.

    One pass of running totals over the train ladder and the new values together.
    With ``center`` the mean of the n + 1 ranks is taken off.
    """
    zero = F.lit(0.0)
    asked = values.select("feature", "value").distinct().select(
        "feature", "value", F.lit(0).cast("long").alias("cnt"), zero.alias("hi"), zero.alias("lo"),
        F.lit(1).alias("asked"),
    )
    both = (
        powers.withColumn("asked", F.lit(0))
        .unionByName(asked)
        .groupBy("feature", "value")
        .agg(
            F.sum("cnt").alias("cnt"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"),
            F.max("asked").alias("asked"),
        )
    )
    totals = powers.groupBy("feature").agg(F.sum("hi").alias("hi_total"))
    run = running_totals(materialize(both), ["feature"], "value", ["cnt", "hi", "lo"], value_bucket(F.col("value")))
    d = F.lit(n + 2.0) - (F.col("cnt_before") + F.col("cnt") / 2.0 + 1.0)
    r = F.pow(d, F.lit(nu - 1.0))
    above = F.col("hi_total") - F.col("hi_before") - F.col("hi")
    mean = (above + F.col("lo_before") + (F.col("cnt") + 1) * r) / (n + 1.0)
    return (
        run.where("asked = 1")
        .join(totals, "feature")
        .select("feature", "value", (r - mean if center else r).alias("r"))
    )
