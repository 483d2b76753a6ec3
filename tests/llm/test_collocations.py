"""Collocations against plain counting of every n-gram."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from jurispark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, w1 string, n long"


def slow(data, min_count=10, covered=50, top=2000):
    f = {}
    for _, text, lang in data:
        count = f.setdefault("und" if lang is None else lang, Counter())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                count.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, count in f.items():
        total = sum(n for g, n in count.items() if len(g) == 1)
        candidates = {g: n for g, n in count.items() if len(g) > 1 and n >= min_count}
        rows = []
        for g, a in candidates.items():
            longer = [n for h, n in candidates.items() if len(h) > len(g) and g in (h[:2], h[1:])]
            if any(100 * n >= covered * a for n in longer):
                continue
            cuts = [(1_000_000 * a * a // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return out


def check(spark, data, **options):
    docs = spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA)
    rows = collocations.collocations(docs, **options).collect()
    got = {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows}
    assert len(rows) == len(got)
    assert got == slow(data, **options)
    return got


def corpus():
    rng = random.Random(4)
    pool = ["the", "of", "And", "x", "É", "é", "a-b", "n1", " z"] + [f"rare{i}" for i in range(300)]
    weights = [30, 20, 10, 8, 6, 6, 5, 4, 3] + [0.1] * 300
    data = []
    for i in range(300):
        words = rng.choices(pool, weights, k=rng.choice([0, 1, 2, 3, 30, 120]))
        if i % 3 == 0:
            words += "New York City hall".split()
        ends = [" ", " ", " ", " ", "\t ", ", ", ". ", "\n", "\x0b", "!"]
        data.append((i, "".join(w + rng.choice(ends) for w in words), rng.choice(["en", "fr", "fr", None])))
    data += [(300, None, "en"), (301, "", None), (302, "only once", "zz"), (303, "q r " * 40_000, "fr")]
    return data + [(None, "same row twice", "en")] * 12


@pytest.mark.parametrize("waiting, chars", [(1_500_000, 8_000_000), (50, 2_000)])
def test_equals_plain_counting(spark, monkeypatch, waiting, chars):
    monkeypatch.setattr(collocations, "WAITING", waiting)
    monkeypatch.setattr(collocations, "BUCKET_CHARS", chars)
    assert len(check(spark, corpus())) > 50


def test_other_limits_and_ties(spark):
    check(spark, corpus(), min_count=3, covered=90, top=7)


def test_empty_tables(spark):
    assert check(spark, []) == set()
    assert check(spark, [(1, None, None), (2, " .,\n", "en")]) == set()


def test_buckets_whatever_the_map_tasks_saw(spark):
    """A pair that is frequent in one map task and rare in another is counted in full."""
    rng = random.Random(5)
    words = [[f"w{rng.randrange(6)}".encode() for _ in range(rng.choice([3, 40]))] for _ in range(60)]
    whole, blocks = Counter(), {}
    for piece in words:
        whole.update(tuple(([*piece, None, None])[i : i + 3]) for i in range(len(piece)))
    for part in (words[:1], words[1:3], words[3:]):
        number = collocations.numbering()
        flat = np.array([number[w] for p in part for w in p], np.int64)
        window = collocations.windows(flat, np.array([len(p) for p in part]))
        window, n = collocations.counted(window, np.ones(len(flat), np.int64), len(number))
        for bucket, sure, block in collocations.dealt(list(number), window, n, 4, 10):
            blocks.setdefault((bucket, sure), []).append(collocations.unpack(block))
    got = Counter()
    for (_, sure), found in blocks.items():
        names, window, n = collocations.merged(found)
        if not sure:
            window, n = collocations.padded(window, n, 10)
        for x, k in zip(window.T.tolist(), n.tolist(), strict=True):
            got[tuple(names[i - 1] if i else None for i in x)] += k
    for order in (1, 2, 3):
        want = Counter()
        for g, n in whole.items():
            want[g[:order]] += n
        for g, n in want.items():
            if order == 1 or (n >= 10 and None not in g):
                assert sum(k for h, k in got.items() if h[:order] == g) == n
    assert sum(got.values()) == sum(whole.values())


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**13
    rows = [("en", "p", None, None, 1, big + 7), ("en", "q", None, None, 1, big + 1), ("en", "p", "q", None, 2, big)]
    table = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, words int, f long")
    (row,) = collocations._scored(table).collect()
    assert (row["l"], row["r"], row["score"]) == (big + 7, big + 1, 10**6 * big * big // ((big + 7) * (big + 1)))
