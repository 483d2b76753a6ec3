"""Choosing rows: claims, single-claim decisions, balanced training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import shuffle_bucket, shuffle_key
from .skew import row_numbers


def matching_claims(claims: DataFrame, object_: str, norm: str, object_value, norm_value) -> DataFrame:
    """Claims about one object under one norm (a plain predicate, so it reaches the scan)."""
    return claims.where((F.col(object_) == object_value) & (F.col(norm) == norm_value))


def single_claims(claims: DataFrame, key: str, outcome: Column) -> DataFrame:
    """(key, outcome) of decisions with exactly one claim."""
    return (
        claims.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.trim(outcome)).alias("outcome"))
        .where("_n = 1")
        .drop("_n")
    )


def with_documents(selected: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Selected decisions that have a document."""
    return selected.join(documents, key)


def without_documents(selected: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Selected decisions whose document is missing."""
    return selected.join(documents, key, "left_anti")


def select_decisions(claims: DataFrame, documents: DataFrame, key: str, outcome: Column) -> DataFrame:
    """(key, outcome, found): single-claim decisions, and 1 if their document exists.

    The rows with ``found`` 0 are the list of missing documents.
    """
    present = documents.select(key).distinct().withColumn("_there", F.lit(1))
    return (
        single_claims(claims, key, outcome)
        .join(present, key, "left")
        .select(key, "outcome", F.coalesce("_there", F.lit(0)).alias("found"))
    )


def balance_classes(rows: DataFrame, label: str, row_id: str, seed: int = 0) -> DataFrame:
    """Keep as many pseudo-random rows of each class as the smallest class has."""
    smallest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    keyed = rows.withColumn("_key", shuffle_key(seed, F.col(row_id)))
    numbered = row_numbers(keyed, [label], ["_key", row_id], shuffle_bucket(F.col("_key")), "_rn")
    return numbered.where(F.col("_rn") <= smallest).drop("_key", "_rn")
