"""Term statistics: bags, document frequencies, weights, document vectors.

A document is one row, so everything that concerns a single document (n-grams,
counts, frequencies) is computed inside the row; only statistics per term and
norms per document move data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.weights import signed_chi2


def with_ngrams(
    docs: DataFrame,
    text: str = "text",
    nmin: int = 1,
    nmax: int = 1,
    name: str = "ngrams",
    words: str | None = None,
) -> DataFrame:
    """Add the array of n-grams of a text column, or of a column of tokens (``words``)."""
    if words is None:
        words, docs = "_words", docs.withColumn("_words", T.tokens(F.col(text)))
    return docs.withColumn(name, T.ngram_range(F.col(words), nmin, nmax)).drop("_words")


def explode_terms(docs: DataFrame, keep: Sequence[str], terms: Column) -> DataFrame:
    """One row per array element, as ``term``.

    The outer form is on purpose: for the inner one the optimizer adds a filter on
    the array, which would tokenise every text again.
    """
    return docs.select(*keep, F.explode_outer(terms).alias("term")).where("term is not null")


def bags(docs: DataFrame, keep: Sequence[str], ngrams: str = "ngrams") -> DataFrame:
    """(keep..., size, bag): one row per document, with the (term, cnt) of its n-grams.

    Counted inside the row: sort the n-grams, find where runs start, and take the
    distances between starts.  No shuffle.
    """
    # NULL elements are no terms: they neither count nor start a run.
    runs = docs.select(*keep, F.sort_array(F.array_compact(ngrams)).alias("_sorted")).withColumn(
        "_starts",
        F.filter(
            F.sequence(F.lit(0), F.size("_sorted") - 1),
            lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)),
        ),
    )
    entries = F.transform(
        F.col("_starts"),
        lambda start, j: F.struct(
            F.get("_sorted", start).alias("term"),
            (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - start)
            .cast("long")
            .alias("cnt"),
        ),
    )
    return runs.select(*keep, F.size("_sorted").cast("long").alias("size"), entries.alias("bag"))


def unpacked(bagged: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., term, cnt, size): the rows of ``bags``, one per term."""
    return (
        bagged.select(*keep, "size", F.inline_outer("bag"))
        .where("term is not null")
        .select(*keep, "term", "cnt", "size")
    )


def term_counts(
    docs: DataFrame, keep: Sequence[str], ngrams: str = "ngrams"
) -> DataFrame:
    """(keep..., term, cnt, size): count of each n-gram of a document, and of all of them.  No shuffle."""
    return unpacked(bags(docs, keep, ngrams), keep)


def document_frequency(docs: DataFrame, ngrams: str = "ngrams") -> DataFrame:
    """(term, df): number of documents that hold the term."""
    return (
        explode_terms(docs, [], F.array_distinct(ngrams))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def class_document_frequency(
    docs: DataFrame, label: str, classes: Sequence, ngrams: str = "ngrams"
) -> DataFrame:
    """(term, df, n_0, n_1, ...): document frequency, overall and per class, zeros included.

    One pass with partial sums; a class that lacks the term simply counts 0.
    """
    return (
        explode_terms(docs, [label], F.array_distinct(ngrams))
        .groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("df"),
            *[
                F.count_if(F.col(label).eqNullSafe(F.lit(c))).alias(f"n_{i}")
                for i, c in enumerate(classes)
            ],
        )
    )


def class_term_counts(docs: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """Long form of ``class_document_frequency``: (term, label, n_term_class, df)."""
    wide = class_document_frequency(docs, label, classes)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias(label), F.col(f"n_{i}").alias("n_term_class"))
            for i, c in enumerate(classes)
        ]
    )
    return wide.select("term", "df", F.inline(cells))


def distinct_labels(df: DataFrame, label: str = "label", limit: int = 1_000) -> list:
    """The classes in sorted order.  Refuses label columns that are clearly not classes."""
    found = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"column {label!r} has more than {limit} distinct values")
    return sorted(found)


def class_sizes(df: DataFrame, label: str, classes: Sequence) -> dict:
    """{class: number of rows} and the total under None, in one aggregate."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(label) == F.lit(c)).alias(f"c{i}") for i, c in enumerate(classes)],
    ).first()
    return {None: row["n"], **{c: row[f"c{i}"] for i, c in enumerate(classes)}}


def vocabulary(docs: DataFrame, df_min: int = 2, ngrams: str = "ngrams") -> DataFrame:
    """Terms that occur in at least ``df_min`` documents."""
    return document_frequency(docs, ngrams).where(F.col("df") >= df_min)


def idf_weights(docs: DataFrame, df_min: int = 2, ngrams: str = "ngrams") -> DataFrame:
    """(term, df, gweight) with gweight = ln(N / df); terms in every document drop out."""
    total = docs.agg(F.count(F.lit(1))).scalar()
    return (
        vocabulary(docs, df_min, ngrams)
        .withColumn("gweight", F.log(total / F.col("df")))
        .where(F.col("gweight") != 0)
    )


def chi2_scores(docs: DataFrame, label: str = "label", ngrams: str = "ngrams") -> DataFrame:
    """(term, df, label, n_term_class, chi2): signed association of each term and class."""
    classes = distinct_labels(docs, label)
    sizes = class_sizes(docs, label, classes)
    class_n = F.create_map(*[F.lit(x) for c in classes for x in (c, sizes[c])])
    return class_term_counts(docs, label, classes).withColumn(
        "chi2",
        signed_chi2(F.lit(sizes[None]), F.col("df"), F.col("n_term_class"), class_n[F.col(label)]),
    )


def top_terms(scores: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """(group, term, rank, score) of the ``n`` best terms per group; ties go by name.

    Best terms are found inside slices of the vocabulary first, so no task has to
    sort all terms of a group.
    """
    order = [F.col(score).desc(), F.col("term")]
    slices = scores.withColumn("_slice", F.pmod(F.xxhash64("term"), F.lit(256)))
    partial = slices.withColumn(
        "rank", F.row_number().over(W.partitionBy(group, "_slice").orderBy(*order))
    ).where(F.col("rank") <= n)
    return (
        partial.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
        .where(F.col("rank") <= n)
        .select(group, "term", "rank", score)
    )


def normalise(
    weights: DataFrame, keys: Sequence[str], weight: str = "weight", norm: str | None = "compat"
) -> DataFrame:
    """Scale the weights of each document by its Euclidean norm.

    ``compat`` multiplies by the norm (what the published results used), ``l2``
    divides by it, None leaves the weights alone.
    """
    if norm is None:
        return weights
    length = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(W.partitionBy(*keys)))
    if norm == "compat":
        return weights.withColumn(weight, F.col(weight) * length)
    if norm == "l2":
        return weights.withColumn("_length", length).withColumn(
            weight, F.when(F.col("_length") > 0, F.col(weight) / F.col("_length")).otherwise(0.0)
        ).drop("_length")
    raise ValueError(f"unknown norm {norm!r}")


def weigh(
    counts: DataFrame, local: Column, gweights: DataFrame, n_terms: int | None = None
) -> DataFrame:
    """Local weight times global weight; terms outside the model drop out.

    ``gweights`` is (term, df, gweight); df doubles as the number of matching rows
    of a term, which is what the skew-aware join needs.
    """
    from .skew import weighted_join

    keys = [c for c in counts.columns if c not in ("term", "cnt", "size")]
    return (
        weighted_join(
            counts.withColumn("_local", local),
            gweights.select("term", "df", "gweight"),
            ["term"],
            weight="df",
            salt_from=keys[:1],
            right_rows=n_terms,
        )
        .withColumn("weight", F.col("_local") * F.col("gweight"))
        .select(*keys, "term", "weight")
    )
