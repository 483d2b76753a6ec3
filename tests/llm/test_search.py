"""Searches against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from jurispark.llm import blocks, maxscore, multi_index

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def odd_rows(dim):
    nan, inf = math.nan, math.inf
    return [
        (9000, None), (9020, [nan] + [1.0] * (dim - 1)), (9040, [inf] * dim), (9060, []), (None, [1.0] * dim),
        (9080, [1.0] * (dim + 1)), (9100, [None] + [1.0] * (dim - 1)),
    ]


def brute(ids, x, own, query, k):
    order = sorted((-float(v @ query), i) for i, v in zip(ids, x, strict=True) if i != own)
    return [(i, -s) for s, i in order[:k]]


def test_maxscore_is_exact(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 64)
    monkeypatch.setattr(blocks, "QUERIES", 3)
    rng = np.random.default_rng(0)
    for dense in (True, False):
        x = rng.normal(size=(300, 12)) * (1 if dense else rng.random((300, 12)) < 0.15)
        x = np.round(x * 4) / 4 if not dense else x
        x[7] = 0
        x = x.astype(np.float32)
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd_rows(12) + [(299, x[299].tolist())]
        got = maxscore.search(frame(spark, rows), F.col("id") % 20 == 0, 5).collect()
        whole = np.floor(1024 * np.vstack([x, x[299:]]).astype(float))
        ids = [*range(300), 299]
        for q in range(0, 300, 20):
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            want = brute(ids, whole, q, whole[q], 5)
            assert [(i, s) for _, i, s in mine] == want


def test_maxscore_skips_terms():
    """With one strong term the weak ones are only probed for the documents still in play."""
    rng = np.random.default_rng(1)
    x = np.zeros((1000, 30), np.int64)
    x[:, 0] = rng.integers(0, 1000, 1000)
    x[:, 1:] = rng.integers(0, 2, (1000, 29))
    q = np.ones(30, np.int64)
    q[0] = 100
    p = maxscore.Postings(x)
    at, score = p.top(q, np.arange(1000), -1, 10, None)
    want = brute(range(1000), x, -1, q, 10)
    assert [(int(a), float(s)) for a, s in zip(at, score, strict=True)] == want


def test_few_candidates_and_empty(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0])])
    got = [tuple(r) for r in multi_index.search(df, F.col("id") == 0, 20).collect()]
    assert got == [(0, 1, 1, 0.5)]
    got = [tuple(r) for r in maxscore.search(df, F.col("id") == 0, 20).collect()]
    assert sorted(got) == [(0, 1, 1, 512 * 1024), (0, 2, 2, 0)]
    for module in (multi_index, maxscore):
        assert module.search(frame(spark, []), F.col("id") == 0).collect() == []
        assert module.search(frame(spark, [(1, None)]), F.col("id") == 1).collect() == []


def test_multi_index_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 500)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 24)) * rng.uniform(0.1, 1)
    x = (x * rng.uniform(0.3, 2, (1500, 1))).astype(np.float32)  # unequal lengths
    x[40:80] = x[39]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd_rows(24)
    got = multi_index.search(frame(spark, rows), F.col("id") % 20 == 0, 20).collect()
    wide, hits = x.astype(float), 0
    for q in range(0, 1500, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(math.isclose(s, wide[i] @ wide[q], rel_tol=1e-12) for _, i, s in mine)
        assert mine == sorted(mine, key=lambda r: (-r[2], r[1]))
        hits += len({i for i, _ in brute(range(1500), wide, q, wide[q], 20)} & {i for _, i, _ in mine})
    assert hits / (75 * 20) >= 0.9


def test_tables_find_exactly_the_ball():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**16, (2000, 4)).astype(np.uint16)
    codes[:500] = codes[0] ^ (1 << rng.integers(0, 16, (500, 4))).astype(np.uint16)
    tables = multi_index.Tables(codes)
    for radius in (0, 2, 5, 17, 30, 64):
        got = tables.within(codes[1], radius)
        assert got.tolist() == np.flatnonzero(multi_index.distances(codes, codes[1]) <= radius).tolist()
