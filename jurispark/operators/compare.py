"""Ranking configurations across categories and zones, and choosing parameters.

These work on metric tables: one row per fitted configuration, never per document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Registry names of the four partial-least-squares variants.
PLS_CLASSIFIERS = ("pls_standard", "pls_gini", "pls_logit", "pls_logit_gini")
# Names of the local and global weights a grid of vectorizations spans.
LOCAL_WEIGHTS = ("TP", "TF", "LOGTF", "ATF", "LOGAVE", "AVERAGELocals")
GLOBAL_WEIGHTS = (
    "CHI2", "DBIDF", "DELTADF", "DSIDF", "GSS", "IDF", "IG", "KLD", "MARASCUILO", "NGL", "RF",
    "AVERAGEGlobals",
)


def vectorization_grid(categories: DataFrame) -> DataFrame:
    """Every category with every (global weight, local weight) name."""
    names = F.array(
        *[
            F.struct(
                F.lit(g).alias("global_weight"),
                F.lit(l).alias("local_weight"),
                F.lit(l + g).alias("vectorization"),
            )
            for g in GLOBAL_WEIGHTS
            for l in LOCAL_WEIGHTS
        ]
    )
    return categories.select("*", F.inline(names))


def unpivot_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per configuration and metric."""
    rest = [c for c in metrics.columns if c not in names]
    return metrics.unpivot(rest, list(names), "metric", "score")


def config_summary(scores: DataFrame, config: Sequence[str], category: str = "category") -> DataFrame:
    """Mean, extremes and their categories per configuration; the category views come along.

    ``scope`` is 'Average' over all categories or the name of one, computed together
    by grouping sets.  On equal scores the first category in order is named.
    """
    keys = ["metric", *config]
    worst = F.min(F.struct("score", F.col(category).alias("c")))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col(category).alias("c")))
    return (
        scores.withColumn("_cat", F.col(category))
        .groupingSets([keys, [*keys, "_cat"]], *keys, "_cat")
        .agg(
            F.grouping("_cat").alias("_all"),
            F.avg("score").alias("mean_score"),
            F.min("score").alias("worst_score"),
            worst["c"].alias("worst_category"),
            F.max("score").alias("best_score"),
            best["c"].alias("best_category"),
        )
        .withColumn("scope", F.when(F.col("_all") == 1, "Average").otherwise(F.col("_cat")))
        .drop("_cat", "_all")
    )


def rank_configs(
    summary: DataFrame, config: Sequence[str], classifier: str, variants: Sequence[str]
) -> DataFrame:
    """Best configuration and best of each classifier in ``variants``, with rank and gap."""
    scope = W.partitionBy("metric", "scope")
    order = [F.col("mean_score").desc(), *config]
    return (
        summary.withColumn("rank", F.row_number().over(scope.orderBy(*order)))
        .withColumn("gap_to_best", F.max("mean_score").over(scope) - F.col("mean_score"))
        .withColumn("stability", F.col("best_score") - F.col("worst_score"))
        .withColumn(
            "_first",
            F.row_number().over(W.partitionBy("metric", "scope", classifier).orderBy(*order)),
        )
        .where((F.col("rank") == 1) | (F.col(classifier).isin(*variants) & (F.col("_first") == 1)))
        .drop("_first")
    )


def mean_scores(scores: DataFrame, params: Sequence[str]) -> DataFrame:
    """(params..., mean_score): a fold that failed (NULL) counts as 0."""
    return scores.groupBy(*params).agg(
        F.avg(F.coalesce(F.col("score"), F.lit(0.0))).alias("mean_score")
    )


def best_params(scores: DataFrame, params: Sequence[str]) -> DataFrame:
    """The setting with the highest mean score; on ties the first in ``params`` order."""
    return (
        mean_scores(scores, params)
        .where("mean_score > 0")
        .orderBy(F.round("mean_score", 12).desc(), *params)
        .limit(1)
    )


def top_params(scores: DataFrame, params: Sequence[str], n_top: int = 3) -> DataFrame:
    """Settings with rank 1..n_top and the spread of their fold scores; ties share a rank."""
    means = scores.groupBy(*params).agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )
    ranked = means.withColumn(
        "rank", F.rank().over(W.orderBy(F.round(F.col("mean_score"), 12).desc()))
    )
    return ranked.where(F.col("rank") <= n_top)


def best_params_min(scores: DataFrame, params: Sequence[str], smallest: str) -> DataFrame:
    """Among the settings of rank 1, the one with the smallest value of one parameter."""
    rest = [p for p in params if p != smallest]
    return top_params(scores, params, 1).orderBy(smallest, *rest).limit(1)


def state_of_the_art(preds: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """Metric means over the prediction sets of each algorithm; empty sets do not count."""
    from .metrics import RATES, fold_means

    means = fold_means(preds.where("y_true is not null and y_pred is not null"), by, fold)
    return means.select(*by, *[m for m in RATES if m != "mcc"], "n_folds")
