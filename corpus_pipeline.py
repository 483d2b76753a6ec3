"""The training-data pipeline: each stage is one operator applied to what the one before kept.

toxicity        documents scored as toxic go
near_duplicates one document, the one with the smallest id, of each component of texts whose
                SimHash fingerprints (word 3-shingles) differ in at most 2 bits stays
substrings      words in windows of 20 words that also start earlier go
mixing          documents are repeated or left out so that sources reach their target shares
encoding        SentencePiece ids, source byte ends of the pieces, and the decoded text

Rows with a NULL id: of a component that has rows with an id, they go; of one without, one of
its rows stays.  Of repeated rows with the kept id one stays; rows with one id and different
texts are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.llm import common, mixing, sentencepieces, simhash, substrings, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose nothing keep their blanks; what is left of the others is single-spaced."""
    found = substrings.deduplicate(docs, carry=("lang", "source"))
    left = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return (
        found.withColumn("text", left)
        .withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
        .select(*COLUMNS)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it."""
    return mixing.repeated(docs.select(*COLUMNS))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = common.tokenizer_path("piece_bpe_32k.model")
    return sentencepieces.encode(docs, model)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

# SQL has neither the trained classifier nor the hash and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        path = common.scratch_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
