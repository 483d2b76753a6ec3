"""Occurrence index of word clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .skew import counted_join, row_numbers

ID_RANGE = 65_536  # ids per numbered range


def clean_dictionary(raw: DataFrame, word: str, cluster: str, position: str | None = None) -> DataFrame:
    """(word, cluster): short rows dropped, words in lower case, the last entry wins.

    ``position`` gives the order of the entries; without it the greatest cluster wins.
    """
    rows = raw.where(F.col(word).isNotNull() & F.col(cluster).isNotNull())
    order = F.struct(position, cluster) if position else F.struct(cluster)
    return rows.groupBy(F.lower(word).alias("word")).agg(F.max_by(cluster, order).alias("cluster"))


def cluster_postings(
    counts: DataFrame,
    dictionary: DataFrame,
    doc_id: str = "doc_id",
) -> DataFrame:
    """(cluster, doc_id, n): occurrences of each cluster in each document.

    ``counts`` is (doc_id, term, cnt): words are counted per document first, so a
    frequent word costs one row per document.
    """
    words = counts.select(doc_id, F.col("term").alias("word"), "cnt")
    return (
        counted_join(words, dictionary.select("word", "cluster"), "word", [doc_id])
        .groupBy("cluster", doc_id)
        .agg(F.sum("cnt").alias("n"))
    )


def cluster_index(postings: DataFrame) -> DataFrame:
    """(cluster, size, n_occ, n_docs); the size is 1 as a cluster counts as one word."""
    return postings.groupBy("cluster").agg(
        F.lit(1).alias("size"), F.sum("n").alias("n_occ"), F.count(F.lit(1)).alias("n_docs")
    )


def posting_lines(postings: DataFrame, doc_id: str = "doc_id", docs_per_line: int = 10_000) -> DataFrame:
    """Text form ``doc-n:doc-n`` of the postings: line ``part`` of a cluster holds its documents
    number ``part * docs_per_line`` and following, in the order of their (integer) ids.

    The documents are numbered inside ranges of ids, so no task holds a whole posting list.
    The postings are written first, as numbering reads them twice.
    """
    postings = materialize(postings)
    ranges = F.floor(F.col(doc_id) / F.lit(ID_RANGE))
    return (
        row_numbers(postings, ["cluster"], [doc_id], ranges, "_rn")
        .withColumn("part", F.floor((F.col("_rn") - 1) / docs_per_line).cast("int"))
        .groupBy("cluster", "part")
        .agg(F.sort_array(F.collect_list(F.struct(doc_id, "n"))).alias("_p"))
        .select(
            "cluster",
            "part",
            F.array_join(
                F.transform("_p", lambda p: F.concat_ws("-", p[doc_id].cast("string"), p["n"].cast("string"))),
                ":",
            ).alias("postings"),
        )
    )


def posting_directory(lines: DataFrame) -> DataFrame:
    """(cluster, part, n_docs, first_doc): what each posting line holds, without reading it."""
    entries = F.split("postings", ":")
    return lines.select(
        "cluster",
        "part",
        F.size(entries).alias("n_docs"),
        F.substring_index(entries[0], "-", 1).alias("first_doc"),
    )


def read_postings(directory: DataFrame, lines: DataFrame, cluster, doc_id: int) -> DataFrame:
    """(doc_id, n) of the one posting line of ``cluster`` that may hold ``doc_id``."""
    mine = directory.where((F.col("cluster") == F.lit(cluster)) & (F.col("first_doc").cast("long") <= doc_id))
    part = mine.agg(F.max("part")).first()[0]
    line = lines.where((F.col("cluster") == F.lit(cluster)) & (F.col("part") == F.lit(part)))
    entry = F.explode(F.split("postings", ":")).alias("e")
    return line.select(entry).select(
        F.substring_index("e", "-", 1).cast("long").alias("doc_id"),
        F.substring_index("e", "-", -1).cast("long").alias("n"),
    )


def index_summary(index: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: number of clusters found and number of documents scanned."""
    n_files = documents.agg(F.count(F.lit(1))).scalar()
    n = F.count(F.lit(1))
    return index.agg(
        n.alias("nb_scanned_words"), n.alias("size_voc"), n.alias("nb_validated_scanned_words")
    ).withColumn("nb_files", n_files)
