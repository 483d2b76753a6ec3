"""Stratified folds, reproducible and computed without one task per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import shuffle_bucket, shuffle_key
from .skew import row_numbers


def stratified_folds(
    rows: DataFrame, k: int, label: str, row_id: str, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Shuffle each class and deal its rows to folds 0..k-1 in turn."""
    if k < 1:
        raise ValueError("k must be at least 1")
    keyed = rows.withColumn("_key", shuffle_key(seed, F.col(row_id)))
    numbered = row_numbers(keyed, [label], ["_key", row_id], shuffle_bucket(F.col("_key")), "_rn")
    return numbered.withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop(
        "_key", "_rn"
    )


def clamped_fold_count(rows: DataFrame, k: int, label: str) -> int:
    """Number of folds such that each one gets every class; at least 2 are needed."""
    smallest = (
        rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    )
    folds = min(k, smallest)
    if folds < 2:
        raise ValueError(f"the smallest class has {smallest} rows: cannot cut {k} folds")
    return folds


def inner_folds(
    rows: DataFrame, k: int, label: str, row_id: str, seed: int = 0, name: str = "fold"
) -> DataFrame:
    """Stratified folds with k clamped to the size of the smallest class."""
    return stratified_folds(rows, clamped_fold_count(rows, k, label), label, row_id, seed, name)


def cv_expand(rows: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """One copy of every row per outer fold, marked as train or test of that fold (``cv``)."""
    return rows.withColumn("cv", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "split", F.when(F.col(fold) == F.col("cv"), "test").otherwise("train")
    )
