"""Substring removal and the FM-index against brute force."""

import random

import numpy as np
import pytest

from jurispark.llm import substrings
from jurispark.llm.fm_index import FMIndex, WaveletMatrix

SCHEMA = "doc_id long, text string, kept string, th int"


def slow(rows, window=20):
    """rows: [(doc_id, text)] in document order -> {doc_id: (n, removed, kept)}."""
    seen, out = {}, {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), (i, p))
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] != (i, p):
                gone |= set(range(p, p + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), b" ".join(kept).decode())
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 50, 200)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += [word() for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.6:
                parts += rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(60 + i, docs[i][1]) for i in range(10)]  # copies
    docs += [(70, "same " * 300), (71, "a b c " * 40), (72, "same " * 25), (73, None), (74, ""), (75, " \n")]
    docs.append((76, " ".join(["é", " ", " x"] * 20)))
    return docs


def check(spark, docs, **settings):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.deduplicate(df, **settings).collect()}
    assert got == slow(docs)


def test_equals_brute_force(spark):
    check(spark, corpus())


def test_hot_minimizers_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SPANS", 2)
    monkeypatch.setattr(substrings, "SPANS_PER_SHARD", 50)
    check(spark, corpus())


def test_a_line_that_all_documents_share(spark):
    rng = random.Random(5)
    line = [f"common{i}" for i in range(12)]
    docs = [
        (i, " ".join([f"u{rng.random()}" for _ in range(30)] + line + [f"v{rng.random()}" for _ in range(30)]))
        for i in range(80)
    ]
    check(spark, docs)


def test_one_very_long_text(spark):
    rng = random.Random(6)
    words = [str(rng.randrange(10**6)) for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[30_000:30_100])), (3, " ".join(words[:10]))]
    check(spark, docs)


def test_null_ids_repeated_rows_and_carried_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame(
        [(5, text, "a", 1), (5, text, "a", 1), (None, text, "b", 1), (6, text, None, 1)], SCHEMA
    )
    got = substrings.deduplicate(df, carry=("kept",)).toDF(
        "doc_id", "n_words", "n_removed", "left", "text", "extra"
    )
    rows = {(r["doc_id"], r["n_removed"], r["text"] == text, r["extra"]) for r in got.collect()}
    assert rows == {(None, 0, True, "b"), (5, 30, True, "a"), (6, 30, True, None)}
    assert got.count() == 4


def test_empty_table(spark):
    assert substrings.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_counts_occurrences(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 3, rng.integers(4, 40)) for _ in range(12)]
    index = FMIndex(texts, 3)
    flat = [tuple(t[i : i + 4]) for t in texts for i in range(len(t) - 3)]
    at = np.concatenate([s + np.arange(len(t) - 3) for s, t in zip(index.starts, texts, strict=True)])
    low, high = index.intervals(at, 4)
    counts = [flat.count(f) for f in flat]
    assert ((high - low == counts) | ((high - low == 1) & (np.array(counts) == 1))).all()
    groups = {}
    for f, lo in zip(flat, low.tolist(), strict=True):
        if flat.count(f) > 1:
            assert groups.setdefault(f, lo) == lo


def test_wavelet_matrix_rank():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 500)
    m = WaveletMatrix(seq.astype(np.int32), 37)
    at, symbol = rng.integers(0, 501, 300), rng.integers(0, 37, 300)
    want = [(seq[:a] == c).sum() for a, c in zip(at, symbol, strict=True)]
    assert m.rank(symbol.astype(np.int32), at.astype(np.int32)).tolist() == want
