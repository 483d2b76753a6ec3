"""Water-filling and sampling against plain Python."""

import math
import random

import pytest

from jurispark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int"


def slow_targets(sizes, weights, epochs=3):
    """Clamp and reshare, round by round; sizes by source."""
    free, target = set(sizes), dict.fromkeys(sizes, 0.0)
    left = float(sum(sizes.values()))
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * unit > epochs * sizes[s]}
        if not over:
            target.update({s: weights[s] * unit for s in free})
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        free -= over
    return target


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "é", "z", "big"]
    rows = []
    for i in range(400):
        s = rng.choice(sources + ["big"] * 4)
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 30])), s))
    rows += [(1000, None, "only_null"), (1001, "x", "tiny")]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    if None in sizes:
        names.append(None)
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    want = slow_targets(sizes, weights)
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], want[s], abs_tol=1e-6) for r in mine)
        assert all(r["source_size"] == sizes[s] for r in mine)
        assert all(r["taken"] == r["size"] * r["repeats"] and 0 <= r["repeats"] <= 3 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= largest[s] / 2 + 1e-6
    assert math.isclose(sum(want.values()), sum(sizes.values()))


def test_reruns_agree_and_rows_are_repeated(spark):
    rows = [(i, "a b c" if i % 2 else "d e", f"s{i % 5}") for i in range(60)]
    df = frame(spark, rows)
    first = sorted(map(tuple, mixing.mix(df).collect()))
    assert first == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    out = mixing.repeated(df)
    assert out.columns == df.columns
    times = {}
    for r in out.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mix(df).collect()}
    assert times == {k: v for k, v in repeats.items() if v}


def test_ties_null_ids_and_nothing(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (1, "c", "t"), (1, "c", "t")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 4 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(frame(spark, [])).collect() == []
    empty = mixing.mix(frame(spark, [(1, "", "s"), (2, None, None)])).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_targets_are_met_without_ids(spark):
    rows = [(None, f"w{i} " * (1 + i % 9), "abc"[i % 3]) for i in range(1000)]
    got = mixing.mix(frame(spark, rows)).collect()
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 9
