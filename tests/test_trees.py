"""Trees grown level by level against a recursive statement."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jurispark.operators import search, subtrees, trees
from jurispark.operators import vectors as vectors_module
from jurispark.operators.matrix import Matrix
from jurispark.operators.registry import classifier


def as_matrix(spark, X, y):
    rows = [(i, int(y[i]), [float(v) for v in x]) for i, x in enumerate(X)]
    table = spark.createDataFrame(rows, "id long, label int, features array<double>")
    return Matrix.from_arrays(table, "id", F.col("label"), F.col("features"))


def score(counts, criterion):
    total = sum(counts)
    if criterion == "gini":
        return sum(c * c for c in counts) / total
    return sum(c * math.log(c / total) for c in counts if c > 0)


def splits(X, y, k, s, w):
    """{node: (feature, threshold, gain)} of the tree with best splits."""
    out, stack = {}, [(1, np.arange(len(X)), 0)]
    weigh = lambda rows: [float((w[rows] * (y[rows] == c)).sum()) for c in range(k)]
    while stack:
        node, rows, depth = stack.pop()
        own = weigh(rows)
        least = math.ceil(s.min_samples_split * len(X)) if s.min_samples_split < 1 else s.min_samples_split
        if sum(c > 0 for c in own) < 2 or len(rows) < least or depth >= (s.max_depth or 99):
            continue
        best = None
        for f in range(X.shape[1]):
            values = sorted(set(X[rows, f]))
            for a, b in zip(values, values[1:]):
                left, right = rows[X[rows, f] <= a], rows[X[rows, f] > a]
                if min(len(left), len(right)) < s.min_samples_leaf:
                    continue
                got = score(weigh(left), s.criterion) + score(weigh(right), s.criterion)
                found = (-round(got, 9), f, a, (a + b) / 2, got - score(own, s.criterion), left, right)
                if best is None or found[:3] < best[:3]:
                    best = found
        if best:
            out[node] = best[1], best[3], best[4]
            stack += [(2 * node, best[5], depth + 1), (2 * node + 1, best[6], depth + 1)]
    return out


def best_first(found, leaves):
    kept, frontier = {}, [1] if 1 in found else []
    while frontier and len(kept) < leaves - 1:
        node = max(frontier, key=lambda n: (round(found[n][2], 9), -n))
        frontier.remove(node)
        kept[node] = found[node]
        frontier += [c for c in (2 * node, 2 * node + 1) if c in found]
    return kept


def data(seed=1, n=90, k=3):
    rng = np.random.default_rng(seed)
    X = np.round(rng.normal(0, 1, (n, 4)), 1)
    X[rng.random((n, 4)) < 0.4] = 0
    y = np.clip((X[:, 0] + X[:, 1] * X[:, 2] > 0.2).astype(int) + (X[:, 3] > 0.8), 0, k - 1)
    y[rng.random(n) < 0.1] = 0
    return X, y


@pytest.mark.parametrize(
    "settings",
    [
        {"max_depth": 4},
        {"criterion": "entropy", "min_samples_split": 0.2, "min_samples_leaf": 3, "max_depth": 5},
        {"class_weight": "balanced", "max_leaf_nodes": 5},
    ],
)
def test_equals_the_recursive_statement(spark, settings):
    X, y = data()
    s = trees.Trees(**settings)
    model = s.fit(as_matrix(spark, X, y))
    w = np.ones(len(X))
    if s.class_weight:
        w = len(X) / (3 * np.bincount(y, minlength=3))[y]
    want = splits(X, y, 3, s, w)
    if s.max_leaf_nodes:
        want = best_first(want, s.max_leaf_nodes)
    got = {r["node"]: (r["feature"], r["threshold"]) for d in model.grown.levels for r in d.where("feature IS NOT NULL").collect()}
    assert {n: v[0] for n, v in got.items()} == {n: v[0] for n, v in want.items()}
    assert all(v[1] == pytest.approx(want[n][1]) for n, v in got.items())

    def walk(x):
        node = 1
        while node in want:
            node = 2 * node + int(x[want[node][0]] > want[node][1])
        return node

    leaves = {}
    for i in range(len(X)):
        leaves.setdefault(walk(X[i]), np.zeros(3))[y[i]] += w[i]
    new = np.round(np.random.default_rng(2).normal(0, 1, (40, 4)), 1)
    pred = {r["id"]: r["y_pred"] for r in model.predict(as_matrix(spark, new, np.zeros(40))).collect()}
    assert pred == {i: int(np.argmax(leaves[walk(x)])) for i, x in enumerate(new)}


def test_forests(spark):
    X, y = data(3, 150, 2)
    train, test = as_matrix(spark, X, y), as_matrix(spark, *data(4, 80, 2))
    drawn = lambda: classifier("ExtraTrees", n_trees=3, max_depth=3)
    first = sorted(map(tuple, drawn().fit(train).predict(test).collect()))
    assert first == sorted(map(tuple, drawn().fit(train).predict(test).collect()))
    sampled = classifier("ExactForest", n_trees=3, max_depth=3).fit(train).predict(test).collect()
    for found in (first, sampled):
        assert sum(a == b for _, a, b in found) >= 0.65 * len(found)
    model = classifier("ExtraTrees", n_trees=3, max_depth=1, max_features=None).fit(train)
    roots = model.grown.levels[0].where("feature IS NOT NULL").collect()
    assert len({r["threshold"] for r in roots}) == 3  # drawn per tree


def test_a_search_equals_single_trees(spark):
    X, y = data(5, 90, 2)
    matrix = as_matrix(spark, X, y).written()
    grid = [{"max_depth": 2}, {"max_depth": 3, "criterion": "entropy", "min_samples_leaf": 4}]
    got = {(r["params"], r["fold"]): r["score"] for r in search.search_scores(matrix, "ExactTree", grid, 3).collect()}
    assert len(got) == 6
    fold, train, test = search.inner_splits(matrix, 3)[1]
    for c in grid:
        rows = classifier("ExactTree", **c).fit(train).predict(test).collect()
        hits = sum(r["label"] == r["y_pred"] for r in rows) / len(rows)
        assert got[json.dumps(c, sort_keys=True), fold] == pytest.approx(hits)


def test_one_class_and_bad_settings(spark):
    one = trees.Trees().fit(as_matrix(spark, [[1.0], [0.0]], [1, 1]))
    assert [r["y_pred"] for r in one.predict(as_matrix(spark, [[3.0]], [0])).collect()] == [1]
    for bad in ({"criterion": "x"}, {"n_trees": 0}, {"max_leaf_nodes": 1}, {"class_weight": "x"}):
        with pytest.raises(ValueError):
            trees.Trees(**bad)


def test_rows_meet_looked_features_first(spark, monkeypatch):
    """With few features a node, rows are joined with those before the cells; the trees stay the same."""
    rows = [(i, i % 2, [float((i * j) % 7 - 3) for j in range(1, 17)]) for i in range(60)]
    m = Matrix.from_arrays(
        spark.createDataFrame(rows, "id int, y int, v array<double>"), "id", F.col("y"), F.col("v")
    ).written()
    seen, write = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    model = trees.extra_trees(n_trees=2, max_depth=2, max_features=2).fit(m)
    ladders = [p for p in seen if "sum(c0" in p and "value#" in p and "Join Inner, ((id#" in p]
    assert any("(feature#" in p.split("Join Inner, ((id#")[1][:80] for p in ladders)
    for level in model.grown.levels:
        assert level.where("feature IS NOT NULL AND feature > 15").count() == 0
    assert model.predict(m).where("y_pred IS NULL").count() == 0


def test_settings_of_a_fold_share_its_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 4))
    m = as_matrix(spark, X, (X[:, 0] > 0).astype(int)).written()
    grid = search.grid_candidates({"maxDepth": [1, 2, 5], "minInstancesPerNode": [1, 5]})
    plain = {}
    for fold, train, test in search.inner_splits(m, 2):
        for c in grid:
            preds = classifier("Tree", **c).fit(train).predict(test)
            plain[json.dumps(c, sort_keys=True), fold] = preds.where("label = y_pred").count() / test.rows.count()
    made, vectors = [], vectors_module.FeatureSpace.vectors
    monkeypatch.setattr(
        vectors_module.FeatureSpace, "vectors", lambda space, matrix: made.append(1) or vectors(space, matrix)
    )
    scores = search.search_scores(m, "Tree", grid, n_folds=2)
    assert len(made) == 4  # two folds, their training and their test rows
    found = {(r["params"], r["fold"]): r["score"] for r in scores.collect()}
    assert found == pytest.approx(plain)


def test_a_fold_without_vectors_has_no_scores(spark):
    m = as_matrix(spark, np.ones((1200, 1)), np.arange(1200))
    rows = m.rows.unionAll(m.rows.withColumn("id", F.col("id") + 5000))
    many = Matrix(rows, m.cells)
    scores = search.search_scores(many, "Tree", [{"maxDepth": 1}, {"maxDepth": 2}], n_folds=2)
    assert [r["score"] for r in scores.collect()] == [None] * 4


def test_failures_are_no_results(spark, monkeypatch):
    """What is not the setting's fault ends a search; failed folds count 0, and a choice needs a score."""
    m = as_matrix(spark, *data(6, 40, 2)).written()
    splits = search.inner_splits(m, 2)

    def broken(error):
        def fit_and_score(setting, train, test):
            raise error

        return fit_and_score

    score = lambda error: search.score_settings(spark, splits, [{"params": "{}"}], broken(error), "params string")
    assert [r["score"] for r in score(ValueError("bad setting")).collect()] == [None, None]
    for error in (RuntimeError("lost executor"), OSError("disk full"), MemoryError()):
        with pytest.raises(type(error)):
            score(error)
        with monkeypatch.context() as patch:
            patch.setattr(vectors_module.FeatureSpace, "vectors", lambda *_, error=error: broken(error)(*_, None))
            with pytest.raises(type(error)):
                search.Tuned("Tree", n_folds=2).fit(m)
    # Repeated cells are no vectors, which MLlib finds in a task: the fold's own fault.
    twice = Matrix(m.rows, m.cells.unionAll(m.cells)).written()
    failed = search.search_scores(twice, "Tree", [{"maxDepth": 1}], n_folds=2)
    assert [r["score"] for r in failed.collect()] == [None, None]
    schema = "params string, fold int, score double"
    a, b = '{"maxDepth": 1}', '{"maxDepth": 2}'
    half = spark.createDataFrame([(a, 0, 0.9), (a, 1, None), (b, 0, 0.7), (b, 1, 0.7)], schema)
    assert search.choose(half, "maxDepth") == {"maxDepth": 2}
    with pytest.raises(ValueError, match="no setting"):
        search.choose(half.withColumn("score", F.lit(None).cast("double")))


def grown_nodes(model):
    """{(m, node): (feature, threshold, class sums)} of levels and subtrees."""
    grown, out = model.grown, {}
    keep = ["m", "node", "feature", "threshold", *[f"c{i}" for i in range(grown.classes)]]
    parts = [d.where("NOT below").select(*keep) for d in grown.levels]
    if grown.subtrees is not None:
        parts.append(grown.subtrees.join(grown.numbers, "fidx", "left").select(*keep))
    for part in parts:
        for r in part.collect():
            assert (r["m"], r["node"]) not in out
            out[r["m"], r["node"]] = tuple(r)[2:]
    return out


@pytest.mark.parametrize("kind", ["dense", "words", "twice"])
def test_small_nodes_grown_by_one_task_are_the_same(spark, monkeypatch, kind):
    X, y = data(7, 70, 3)
    m = as_matrix(spark, X, y)
    settings = {"n_trees": 2, "seed": 3, "max_depth": 5}
    if kind == "words":
        settings.update(criterion="entropy", class_weight="balanced", bootstrap=True, min_samples_leaf=2, max_features=3)
        m = Matrix(m.rows, m.cells.where("value <> 0").withColumn("feature", F.concat(F.lit("é"), "feature")))
    if kind == "twice":
        again = m.rows.where("id % 9 = 0")
        m = Matrix(m.rows.unionAll(again).unionAll(spark.createDataFrame([(None, 1)], m.rows.schema)),
                   m.cells.unionAll(m.cells.join(again.select("id"), "id").select(*m.cells.columns)))
    m = m.written()
    found = {}
    for cells in (subtrees.LOCAL_CELLS, 0):
        monkeypatch.setattr(subtrees, "LOCAL_CELLS", cells)
        model = trees.extra_trees(**settings).fit(m)
        assert (model.grown.subtrees is None) == (cells == 0)
        monkeypatch.setattr(subtrees, "LOCAL_CELLS", 50)  # routed rows come in slices
        found[cells] = grown_nodes(model), sorted(map(str, model.predict(m).collect()))
        levels = len(model.grown.levels)
        assert levels == 2 if cells else levels > 2
    (nodes, preds), (plain, plain_preds) = found.values()
    assert preds == plain_preds and nodes.keys() == plain.keys() and len(nodes) > 10
    for key, node in plain.items():
        assert nodes[key][0] == node[0] and (nodes[key][1] is None) == (node[1] is None)
        assert [x or 0 for x in nodes[key][1:]] == pytest.approx([x or 0 for x in node[1:]], rel=1e-12)


def test_draws_and_rounding_are_those_of_spark(spark):
    ids = [0, 1, -5, 2**31 - 1, 2**59 + 17]
    rows = spark.createDataFrame([(f"w{i}", x) for i, x in enumerate(ids)], "feature string, node long")
    got = rows.select(
        F.xxhash64("feature").alias("s"), F.xxhash64("feature", "node", F.lit(7), F.lit(-3)).alias("h")
    ).collect()
    states = np.array([r["s"] for r in got], np.int64).view(np.uint64)
    hashes = subtrees.hashed_int(subtrees.hashed_int(subtrees.hashed_long(states, np.array(ids)), 7), -3)
    assert list(hashes.view(np.int64)) == [r["h"] for r in got]
    x = [0.0, 0.5e-9, -0.5e-9, 2.4999999995, 12345.6789012345, 77.0000000005, -3.1234567885, 1 / 3, 2 / 3]
    spark_rounds = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert list(subtrees.round_units(np.array(x), 9) / 1e9) == spark_rounds


def test_only_tables_of_nodes_are_broadcast(spark, monkeypatch):
    """What grows with the rows (rows in nodes, cells, carries of running totals) is not sent to the driver."""
    m = as_matrix(spark, *data(8, 60, 2)).written()
    plans, write = [], trees.materialize
    kept = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df)
    counted, write_with = [], trees.materialize_with
    monkeypatch.setattr(trees, "materialize", kept)
    monkeypatch.setattr(trees, "materialize_with", lambda df, *sums: counted.append(
        df._jdf.queryExecution().executedPlan().toString()) or write_with(df, *sums))
    found = search.search_scores(m, "ExactTree", [{"max_depth": 2}], 2)
    plans += [*counted, found._jdf.queryExecution().executedPlan().toString()]
    sides = [p.split("BroadcastExchange")[1:] for p in plans]
    assert sum(map(len, sides)) > 5
    for plan in plans:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                depth, side = len(line) - len(line.lstrip(" :+-")), []
                for below in lines[i + 1 :]:
                    if len(below) - len(below.lstrip(" :+-")) <= depth:
                        break
                    side.append(below)
                if any("Aggregate" in x for x in side):
                    continue  # one row a node, or a count per class
                for read in (x.split("ReadSchema:")[1] for x in side if "FileScan" in x):
                    assert not any(x in read for x in ("id:", "value:", "_bucket:")), read
