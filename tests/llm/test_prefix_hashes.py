"""Prefix hashes and document fingerprints against plain string work."""

import hashlib
import random

import numpy as np
import pytest

from jurispark.llm import prefix_hashes as P

SCHEMA = "doc_id long, text string, part int, z string"


def text_of(rng, n, letters="abé𝄞 "):
    return "".join(rng.choice(letters) for _ in range(n))


def slow_hash(text, k):
    return sum(ord(c) * pow(P.BASES[k], i, P.PRIMES[k]) for i, c in enumerate(text)) % P.PRIMES[k]


def test_prefixes_equal_the_definition(monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 128)
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 128, 700):
        text = text_of(rng, n)
        places = np.arange(n + 1)
        assert P.Prefixes(text).at(places).tolist() == [[slow_hash(text[:i], k) for i in range(n + 1)] for k in (0, 1)]


def test_spans_are_equal_when_their_texts_are():
    rng = random.Random(2)
    text = text_of(rng, 300, "ab")
    p = P.Prefixes(text)
    first = np.array([rng.randrange(300) for _ in range(2000)])
    last = np.array([min(300, a + rng.randrange(6)) for a in first])
    found = P.spans(p, first, last)
    by_hash = {}
    for h, a, b in zip(found.tolist(), first, last, strict=True):
        by_hash.setdefault(h, set()).add(text[a:b])
    assert all(len(texts) == 1 or {t == "" for t in texts} == {True} for texts in by_hash.values())
    assert len(by_hash) == len({text[a:b] for a, b in zip(first, last, strict=True)})


def test_extensions():
    rng = random.Random(3)
    for _ in range(200):
        one = text_of(rng, rng.choice([0, 1, 70, 5000]), "ab")
        cut = rng.randrange(len(one) + 1)
        two = one[cut : cut + rng.randrange(5000)] + text_of(rng, rng.randrange(80), "ab")
        i = rng.choice([0, cut])
        want = 0
        while want < min(len(one) - i, len(two)) and one[i + want] == two[want]:
            want += 1
        assert P.extension(P.Prefixes(one), i, P.Prefixes(two), 0) == want


def test_joined_texts_need_no_reading():
    rng = random.Random(4)
    for _ in range(60):
        a, b = text_of(rng, rng.randrange(400)), text_of(rng, rng.randrange(400))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        joined = P.Joined(P.Prefixes(a), i, P.Prefixes(b), j)
        assert P.fingerprint(joined) == P.fingerprint(P.Prefixes(a[:i] + b[:j]))


def test_likeness_lies_within_a_rung_of_the_shared_ends():
    rng = random.Random(5)
    for _ in range(200):
        a = text_of(rng, rng.randrange(1, 3000))
        i, j = sorted(rng.randrange(len(a) + 1) for _ in range(2))
        b = a[:i] + text_of(rng, rng.randrange(1, 40), "xyz") + a[j:]
        got = P.likeness(P.fingerprint(P.Prefixes(a)), P.fingerprint(P.Prefixes(b)))
        shared = (i + len(a) - j) / max(len(a), len(b))
        assert shared / 2 ** (1 / P.PER_OCTAVE) - 0.02 <= got <= shared + 0.02
        assert got == P.likeness(P.fingerprint(P.Prefixes(b)), P.fingerprint(P.Prefixes(a)))
    marks = [P.fingerprint(P.Prefixes(t)) for t in ("", "", "a", "b")]
    assert [P.likeness(marks[0], m) for m in marks] == [1, 1, 0, 0]
    assert P.likeness(marks[2], marks[3]) == 0


def slow(data):
    digest = lambda t: hashlib.sha256((t or "").encode()).digest()
    rows = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        marks = [P.fingerprint(P.Prefixes(x)) for x in (t, edited, after)]
        common = [next((n for n, (x, y) in enumerate(zip(t, u)) if x != y), min(len(t), len(u))) for u in (edited, after)]
        out.append(
            (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1],
             P.likeness(marks[0], marks[1]), P.likeness(marks[0], marks[2]), *common)
        )
    return sorted(out, key=repr)


def check(spark, data, partitions=None):
    docs = spark.createDataFrame([(*d, 1, "x") for d in data], SCHEMA)
    docs = docs.repartition(partitions) if partitions else docs
    rows = [tuple(r[c] for c in ("doc_id", *P.RESULT)) for r in P.document_fingerprints(docs).collect()]
    assert sorted(rows, key=repr) == slow(data)
    return rows


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_plain_strings(spark, partitions):
    rng = random.Random(6)
    data = [(i, text_of(rng, rng.choice([0, 1, 2, 3, 50, 400, 3000]))) for i in rng.sample(range(1000), 90)]
    data += [(2000 + i, data[i][1]) for i in range(20)]  # copies
    data += [(3000, None), (3001, ""), (3002, "x" * 300_000), (None, None), (None, "n"), (None, "n")]
    data += [(4000, "same")] * 3 + [(4001, "one id"), (4001, "two texts")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = check(spark, data, partitions)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r[3] for r in rows}) == len({t or "" for _, t in data})


def test_few_rows_and_equal_rows(spark):
    assert check(spark, []) == []
    check(spark, [(1, "only")])
    check(spark, [(1, None)])
    check(spark, [(None, "abcdef")] * 40)
