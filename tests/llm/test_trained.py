"""Trained operators: gradients, held-out accuracy, and the odd cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jurispark.llm import common, language, toxicity
from jurispark.llm import pseudo_likelihood as PL

SCHEMA = "doc_id long, text string, lang string, score string, predicted int, n_tokens int"
SYLLABLES = {"aa": "la ko mi ta", "bb": "schü gen ber ung", "cc": "éau oi ment tion"}


def sentence(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    return [
        (9001, None, "aa"), (9002, "", "bb"), (9003, "123 !?", None), (None, "lako mita", "aa"),
        (9004, "lako mi tala komita " * 5_000, None), (9004, "lako mi tala komita " * 5_000, None),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, 7) for r in rows], SCHEMA)


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 16)).astype(np.uint8), rng.integers(0, 3, 5)
    net = language.ByteNetwork.new(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    for name, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = net.weights[name][at]
        net.weights[name][at] = keep + 1e-5
        up = loss()
        net.weights[name][at] = keep - 1e-5
        down = loss()
        net.weights[name][at] = keep
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-3)


def test_language_on_held_out_texts(spark):
    rng = random.Random(0)
    rows = [(i, sentence(rng, lang := rng.choice("aa bb cc".split()), rng.randint(5, 80)), lang) for i in range(240)]
    rows += odd_rows()
    got = language.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:240]}
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 40 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[9001] == by[9002] == by[9003] == "und" and by[9004] == by[None] == "aa"


def test_language_without_labels_or_rows(spark):
    got = language.identify(frame(spark, [(1, "abc", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert language.identify(frame(spark, [])).collect() == []


def test_windows_cover_whole_texts():
    x, counts = language.windows(["a" * 300, None, "b" * 128], 128)
    assert counts.tolist() == [3, 1, 1] and (x == ord("a")).sum() == 300 and (x == ord("b")).sum() == 128


def toxic_corpus(n=600, seed=1):
    rng = random.Random(seed)
    bad = ["vilox", "gruntag", "snarfel", "morblid"]
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, "aa", rng.randint(20, 60)).split()
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "", "um", "an"]))
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = toxic_corpus()
    table = spark.createDataFrame([*labels, (1, None), (None, 1), (77_777, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows + odd_rows()), table).collect()
    assert len(got) == len(rows) + len(odd_rows())
    truth = dict(labels)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    hits = [(truth[r["doc_id"]], r["predicted"]) for r in out]
    assert sum(t for t, _ in hits) > 15
    assert np.mean([p for t, p in hits if t]) > 0.9 and sum(p for t, p in hits if not t) == 0
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] in (9001, 9002, None)} == {0}


def test_toxicity_training_loses_exact_copies_only(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"own{i} {passage} end{i}", i % 2) for i in range(20)]  # a shared passage
    rows += [(50, None, 0), (51, "", 0), (52, " ", 0)]
    copies = [(100, f"OWN3  {passage}\nend3", 1), (101, f"own4 {passage} end4", 0)]
    other = [(102, f"own4 {passage} end4", 1)]  # labelled otherwise
    df = spark.createDataFrame(rows + copies + other, "doc_id long, text string, label int")
    kept = sorted(r["doc_id"] for r in toxicity.without_copies(df).collect())
    assert kept == sorted(i for i, _, _ in rows + other)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, odd_rows()), none).collect()
    assert {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    assert toxicity.toxicity(frame(spark, []), none).collect() == []


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(5000) < 0.2
    rate = [(0.7, 0.02), (0.5, 0.1), (0.3, 0.01), (0.4, 0.2)]
    votes = np.stack([np.where(y, rng.random(5000) < a, rng.random(5000) < b) for a, b in rate], 1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # a copy of the first
    model = toxicity.fit_label_model(votes, votes[:, :4].mean(axis=1))
    assert model.correlations[0, 4] > 0.9 and model.discount[0] < 0.6 and model.discount[1] > 0.8
    assert abs(model.prior - 0.2) < 0.06
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.9


def slow_windows(text, radius=2):
    raw = bytes(radius) + (text or "").encode() + bytes(radius)
    return [raw[i : i + 2 * radius + 1] for i in range(len(raw) - 2 * radius)]


@pytest.mark.parametrize("chunk", [3, 10, 10_000])
def test_window_codes(monkeypatch, chunk):
    monkeypatch.setattr(PL, "CHUNK", chunk)
    texts = ["abc", None, "", "é x", "z" * 50]
    got = {}
    for code, owner in PL.codes(texts):
        for c, o in zip(code.tolist(), owner.tolist(), strict=True):
            got.setdefault(o, []).append(c.to_bytes(5, "big"))
    assert got == {i: slow_windows(t) for i, t in enumerate(texts) if t}


def test_pseudo_likelihood_counts_learns_and_sums(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, "aa", 60), "aa") for i in range(60)] + odd_rows()
    rows.append((500, "".join(rng.choice("qxzjvw#%&") for _ in range(300)), "aa"))
    df = frame(spark, rows)
    want = {}
    for _, t, _ in rows:
        for w in slow_windows(t):
            want[int.from_bytes(w, "big")] = want.get(int.from_bytes(w, "big"), 0) + 1
    assert {r["code"]: r["n"] for r in PL.window_counts(df).collect()} == want
    net = PL.fit(df, rounds=2, steps=80)
    got = {r["doc_id"]: r for r in PL.score(df.select("doc_id", "text"), net).collect()}
    for i, t, _ in rows[:3] + rows[-1:]:
        logs = [net.log_probabilities(np.array([int.from_bytes(w, "big")]))[0] for w in slow_windows(t)]
        assert got[i]["n_tokens"] == len(t.encode()) and math.isclose(got[i]["log_prob"], sum(logs), rel_tol=1e-5)
    assert got[0]["score"] > got[500]["score"] + 1
    assert (got[9001]["n_tokens"], got[9001]["log_prob"], got[9001]["score"]) == (0, 0.0, 0.0)
    empty = frame(spark, [])
    assert PL.score(empty, PL.fit(empty)).collect() == []


def test_held_out_is_the_stated_fold(spark):
    import zlib

    df = spark.range(50).select("id", common.held_out(F.col("id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in df.collect())


def test_patterns_vote_when_no_term_tells(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, "aa", 12) + (" STOP THAT NOW!!!" if i % 5 == 0 else "."), "aa") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    shouted = [s for i, s in got.items() if i % 5 == 0]
    assert min(shouted) > max(s for i, s in got.items() if i % 5)
