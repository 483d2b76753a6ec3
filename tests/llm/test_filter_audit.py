"""The filter audit against filters that are really applied, row by row."""

import random
import re
from itertools import permutations

from jurispark.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, filter int, n int"
LABELS = "doc_id long, quality int, toxic int"


def fails(data):
    """Failed filters of each row, as a set."""
    out = []
    for i, t, _ in data:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            {f for f, bad in zip("ABCDE", (
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                re.search(r"[#$%&*|]", t) is not None,
                i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in data),
            ), strict=True) if bad}
        )
    return out


def slow(data, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = fails(data)
    out, shapley = {}, {}
    for part in {s or "" for _, _, s in data}:
        rows = [k for k, d in enumerate(data) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in failed[k]]
                stay = [k for k in left if f not in failed[k]]
                out[part, "".join(order), step] = [
                    len(stay),
                    len(gone),
                    sum(f in failed[k] for k in rows) - len(gone),
                    sum(failed[k] == {f} for k in rows),
                    sum(data[k][0] in good for k in gone),
                    sum(data[k][0] in toxic for k in gone),
                ]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = stay
    for (part, order, step), x in out.items():
        x.append(shapley[part, order[step - 1]])
    return out


def check(spark, data, labels):
    docs = spark.createDataFrame([(*d, "x", 1, 2) for d in data], SCHEMA)
    found = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))
    got = {(r["part"], r["filter_order"], r["step"]): [r[f] for f in filter_audit.FIGURES] for r in found.collect()}
    assert got == slow(data, labels)
    return got


def corpus():
    rng = random.Random(3)
    data = []
    for i in range(150):
        pool = [f"w{j}" for j in range(rng.choice([40, 400]))] + rng.choice([[], ["Big", "WORDS"], ["a#b", "c|"]])
        words = [rng.choice(pool) for _ in range(rng.choice([0, 5, 150, 199, 200, 260]))]
        data.append((i, rng.choice([" ", "\n", "\x0b\t"]).join(words), rng.choice(["s1", "s2", "", None])))
    for i in range(150, 230):  # copies, in other parts as well
        data.append((i, data[rng.randrange(150)][1], rng.choice(["s1", "s3", None])))
    data += [(None, data[7][1], "s1"), (None, data[7][1], "s1"), (None, None, None)]  # rows without ids
    data += [(300, None, "s2"), (301, "", "s2"), (302, " \n", "s2")]
    data += [(400, "same row", "s1")] * 3 + [(2, "other text under a taken id", "s9")]  # repeated rows
    data += [(500, "word " * 50_000, "s2"), (501, "é" * 300 + "ABCDEF", "s2"), (502, "É" * 294 + "ABCDEF", "s2")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 230, 2)]
    labels += [(4, 0, 0), (None, 1, 1), (9, None, 1), (400, 1, None), (9999, 1, 1)]
    return data, labels


def test_equals_filters_applied_one_by_one(spark):
    data, labels = corpus()
    got = check(spark, data, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in data})


def test_one_large_group_of_copies(spark):
    check(spark, [(i, "a b c", f"s{i % 3}") for i in range(300)], [(0, 1, 0), (7, 1, 1)])


def test_empty_tables(spark):
    assert check(spark, [], []) == {}
    check(spark, [(1, "x", "s")], [])


def test_words_of_a_long_text_are_counted_across_pieces(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5_000)).encode() + b"\n\x0b x"
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    assert filter_audit.word_counts(text) == (5_001, 701)
