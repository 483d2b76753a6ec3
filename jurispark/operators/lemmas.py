"""Dictionary lemmatisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.spread import by_key
from .skew import BROADCAST_ROWS, counted_join


def lemmatize(
    docs: DataFrame,
    lemmas: DataFrame,
    doc_id: str = "doc_id",
    words: str = "words",
) -> DataFrame:
    """(doc_id, words) with each token replaced by its lemma; unknown tokens stay.

    ``lemmas`` is (token, lemma), unique on token.  A dictionary too large
    to broadcast has its frequent tokens counted and spread by document; the tokens of a document
    come back together in order.
    """
    return _replaced(_together(docs, lemmas, doc_id), lemmas, doc_id, words)


def _together(docs: DataFrame, lemmas: DataFrame, doc_id: str) -> DataFrame:
    """Whole documents dealt out by id if the lemmas are broadcast: their tokens need not move then."""
    return by_key(docs, doc_id) if lemmas.count() <= BROADCAST_ROWS else docs


def _replaced(docs: DataFrame, lemmas: DataFrame, doc_id: str, words: str) -> DataFrame:
    placed = docs.select(doc_id, F.posexplode_outer(words).alias("_pos", "token"))
    joined = counted_join(placed, lemmas.select("token", "lemma"), "token", [doc_id], "left")
    ordered = F.sort_array(
        F.collect_list(
            F.when(
                F.col("token").isNotNull(),
                F.struct("_pos", F.coalesce("lemma", "token").alias("word")),
            )
        )
    )
    return joined.groupBy(doc_id).agg(
        F.transform(ordered, lambda x: x["word"]).alias(words)
    )


def clean_with_lemmas(
    docs: DataFrame,
    lemmas: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lower: bool = True,
    remove_punctuation: bool = True,
    remove_single: bool = True,
) -> DataFrame:
    """(doc_id, text): white space, lemmas, letters only, length, lower case, in this order.

    ``docs`` has one row per ``doc_id``.
    """
    split = _together(docs.select(doc_id, text), lemmas, doc_id).select(doc_id, T.tokens(F.col(text)).alias("words"))
    words = T.clean_tokens(F.col("words"), remove_punctuation, remove_single)
    done = F.transform(words, F.lower) if lower else words
    return _replaced(split, lemmas, doc_id, "words").select(doc_id, F.array_join(done, " ").alias("text"))
