"""Helpers shared by the operators: words, folds, stable row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..sources.scratch import scratch_root

# Fixed by the contracts: a word is a run of bytes other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for rows that no label may be learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place below the shared scratch folder."""
    return f"{scratch_root(spark)}/jurispark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file (the operators take the path as a parameter)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def written(df: DataFrame, codec: str) -> DataFrame:
    """Write ``df`` once to the scratch folder with the given compression and read it back."""
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
