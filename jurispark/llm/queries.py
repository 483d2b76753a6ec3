"""The registered queries of the operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    common,
    filter_audit,
    language,
    maxscore,
    mixing,
    multi_index,
    prefix_hashes,
    pseudo_likelihood,
    sentencepieces,
    simhash,
    substrings,
    token_store,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op10_mixing", mixing.SQL)
def op10(spark, sf):
    return mixing.mix(common.documents(spark, sf)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op3_token_store")
def op3(spark, sf):
    folder = common.scratch_folder(spark, "tokens")
    token_store.write_tokens(
        common.documents(spark, sf), folder, common.tokenizer_path("byte_bpe_50k.json")
    )
    return token_store.read_tokens(spark, folder, with_ids=False).withColumnRenamed(
        "row_id", "doc_id"
    )


@query("op2_sentencepiece")
def op2(spark, sf):
    model = common.tokenizer_path("piece_bpe_32k.model")
    return sentencepieces.digests(sentencepieces.encode(common.documents(spark, sf), model))


@query("op9_simhash")
def op9(spark, sf):
    return simhash.near_duplicates(common.documents(spark, sf))


@query("op8_toxicity")
def op8(spark, sf):
    return toxicity.toxicity(common.documents(spark, sf), common.table(spark, sf, "labels"))


@query("op4_language")
def op4(spark, sf):
    return language.identify(common.documents(spark, sf))


@query("op5_pseudo_likelihood")
def op5(spark, sf):
    docs = common.documents(spark, sf)
    net = pseudo_likelihood.fit(docs)
    return pseudo_likelihood.score(docs.select("doc_id", "text"), net).drop("text")


@query("op1_multi_index")
def op1(spark, sf):
    vectors = common.table(spark, sf, "embeddings")
    return multi_index.search(vectors, F.col("id") % 20 == 0, 20)


@query("op6_maxscore", maxscore.SQL)
def op6(spark, sf):
    vectors = common.table(spark, sf, "embeddings")
    return maxscore.search(vectors, F.col("id") % 100 == 0, 10)


@query("op7_substrings", substrings.SQL)
def op7(spark, sf):
    return substrings.deduplicate(common.documents(spark, sf)).select(
        "doc_id", "n_words", "n_removed", common.sha256(F.col("kept")).alias("kept_sha256")
    )


@query("op11_filter_audit", filter_audit.SQL)
def op11(spark, sf):
    return filter_audit.audit(
        common.documents(spark, sf), common.table(spark, sf, "labels")
    ).drop("filter")


@query("op13_collocations", collocations.SQL)
def op13(spark, sf):
    return collocations.collocations(common.documents(spark, sf))


@query("op12_prefix_hashes")
def op12(spark, sf):
    return prefix_hashes.document_fingerprints(common.documents(spark, sf))
