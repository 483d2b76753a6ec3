"""Kernel machines against a dense statement, on data that no line cuts, and drawn settings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from jurispark.operators import kernel_svm, search
from jurispark.operators.kernel_svm import KernelSVM
from jurispark.operators.matrix import Matrix
from jurispark.operators.registry import classifier


def as_matrix(spark, X, y):
    rows = [(i, y[i].item() if hasattr(y[i], "item") else y[i], [float(v) for v in x]) for i, x in enumerate(X)]
    kind = "string" if isinstance(rows[0][1], str) else "int"
    table = spark.createDataFrame(rows, f"id long, label {kind}, features array<double>")
    return Matrix.from_arrays(table, "id", F.col("label"), F.col("features"))


def rings(seed, n):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(y, 3.0, 1.0) + rng.normal(0, 0.2, n)
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]), y


def dense(setting, X, sign, L, steps=400):
    """Weights by plain Newton steps with halving, in one array."""
    def kernel(A, B):
        inner = A @ B.T
        if setting.kernel == "rbf":
            return np.exp(-setting.gamma * ((A[:, None] - B[None]) ** 2).sum(axis=2))
        if setting.kernel == "poly":
            return (setting.gamma * inner + setting.coef0) ** setting.degree
        return np.tanh(setting.gamma * inner + setting.coef0) if setting.kernel == "sigmoid" else inner

    K = np.column_stack([kernel(X, L), np.ones(len(X))])
    values, vectors = np.linalg.eigh(kernel(L, L))
    P = np.zeros((len(L) + 1,) * 2)
    P[:-1, :-1] = (vectors * np.maximum(values, 0)) @ vectors.T
    loss = lambda w: w @ P @ w / 2 + setting.C * (np.maximum(1 - sign * (K @ w), 0) ** 2).sum()
    w = np.zeros(K.shape[1])
    for _ in range(steps):
        on = sign * (K @ w) < 1
        after = np.linalg.solve(P + 2 * setting.C * K[on].T @ K[on] + 1e-12 * np.eye(len(w)), 2 * setting.C * K[on].T @ sign[on])
        while loss(after) > loss(w) + 1e-12 and np.abs(after - w).max() > 1e-13:
            after = (after + w) / 2
        w = after
    return kernel, w, loss


@pytest.mark.parametrize(
    "setting",
    [KernelSVM("linear", 0.5), KernelSVM("rbf", 2.0, 0.7), KernelSVM("poly", 1.0, 0.3, 2, 1.0), KernelSVM("sigmoid", 1.0, 0.1)],
)
def test_equals_the_dense_statement(spark, setting):
    setting = KernelSVM(**{**setting.__dict__, "n_landmarks": 6})
    rng = np.random.default_rng(1)
    X = np.round(rng.normal(0, 1, (80, 3)), 1)
    X[:10] = 0  # rows without cells
    y = (X[:, 0] + X[:, 1] ** 2 + rng.normal(0, 0.3, 80) > 0.5).astype(int)
    matrix = as_matrix(spark, X, y)
    model = setting.fit(matrix)
    order = matrix.rows.orderBy(kernel_svm.shuffle_key(0, F.col("id")), "id").limit(6).collect()
    L = X[[r["id"] for r in order]]
    kernel, w, loss = dense(setting, X, 2.0 * y - 1, L)
    assert loss(model.weights[0]) <= loss(w) * (1 + 1e-6)
    margins = {r["id"]: r["margins"][0] for r in model.decision(matrix).collect()}
    own = kernel(X, L) @ model.weights[0][:-1] + model.weights[0][-1]
    assert np.allclose([margins[i] for i in range(80)], own, atol=1e-9)


def accuracy(model, matrix):
    rows = model.predict(matrix).collect()
    return sum(r["label"] == r["y_pred"] for r in rows) / len(rows)


def test_rings_need_a_kernel(spark):
    train, test = as_matrix(spark, *rings(1, 300)), as_matrix(spark, *rings(2, 200))
    assert accuracy(classifier("SVM", n_landmarks=40).fit(train), test) >= 0.98
    assert accuracy(KernelSVM("poly", 1.0, 0.5, 2, n_landmarks=40).fit(train), test) >= 0.98
    assert accuracy(KernelSVM("linear", n_landmarks=40).fit(train), test) <= 0.7


def test_three_named_classes_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    names = np.array(["a", "b", "c"])[np.arange(150) % 3]
    centres = {"a": (0, 4), "b": (4, 0), "c": (-4, -4)}
    X = np.array([centres[n] for n in names]) + rng.normal(0, 0.5, (150, 2))
    matrix = as_matrix(spark, X, [str(n) for n in names])
    assert accuracy(KernelSVM(n_landmarks=20).fit(matrix), matrix) == 1.0
    new = as_matrix(spark, [[0.0, 0.0], [9.0, 9.0]], ["z", "z"])
    assert {r["y_pred"] for r in KernelSVM(n_landmarks=20).fit(matrix).predict(new).collect()} <= {"a", "b", "c"}
    same = as_matrix(spark, [[1.0, 2.0]] * 30, np.arange(30) % 2)  # equal rows, equal landmarks
    assert len(KernelSVM(n_landmarks=8).fit(same).predict(same).collect()) == 30
    with pytest.raises(ValueError):
        KernelSVM().fit(as_matrix(spark, [[1.0]], [1]))
    with pytest.raises(ValueError):
        KernelSVM("cubic")


def test_a_search_equals_single_fits_and_takes_one_pass_a_step(spark, monkeypatch):
    X, y = rings(4, 160)
    matrix = as_matrix(spark, X, y).written()
    grid = [{"kernel": k, "C": c, "gamma": 0.5, "degree": 2, "n_landmarks": 12} for k in ("linear", "rbf", "poly") for c in (0.1, 5.0)]
    passes = []
    sums = kernel_svm._sums
    monkeypatch.setattr(kernel_svm, "_sums", lambda *a: passes.append(len(a[-1])) or sums(*a))
    got = {(r["params"], r["fold"]): r["score"] for r in search.search_scores(matrix, "SVM", grid, 3).collect()}
    assert len(got) == 18 and passes[0] == 18 and len(passes) < 18
    marks = kernel_svm.Landmarks.of(matrix, 12)
    for fold, train, test in search.inner_splits(matrix, 3):
        monkeypatch.setattr(kernel_svm.Landmarks, "of", staticmethod(lambda *a, marks=marks: marks))
        for c in (grid[0], grid[3]):
            assert accuracy(KernelSVM(**c).fit(train), test) == pytest.approx(got[json.dumps(c, sort_keys=True), fold])
        monkeypatch.undo()
        break
    assert search.choose(search.search_scores(matrix, "SVM", grid, 3))["kernel"] != "linear"


def test_draws(spark):
    many = {f"p{i}": range(100) for i in range(12)}  # 10^24 combinations
    some = search.random_candidates(many, 20, seed=1)
    assert some == search.random_candidates(many, 20, seed=1) != search.random_candidates(many, 20, seed=2)
    assert len({json.dumps(c) for c in some}) == 20 and all(0 <= v < 100 for c in some for v in c.values())
    small = {"a": [1, 2, 3], "b": "xyzt"}
    assert [search.combination(small, i) for i in range(12)] == search.grid_candidates(small)
    assert len({json.dumps(c) for c in search.random_candidates(small, 11)}) == 11
    ranges = {"C": search.Uniform(0.5, 2.0), "degree": search.Integers(2, 4), "kernel": ["rbf", "poly"]}
    drawn = search.random_candidates(ranges, 200, seed=3)
    assert all(0.5 <= c["C"] <= 2 and c["degree"] in (2, 3, 4) for c in drawn)
    assert {c["degree"] for c in drawn} == {2, 3, 4} and len({c["C"] for c in drawn}) == 200
    matrix = as_matrix(spark, *rings(5, 90))
    best = search.random_search(matrix, "SVM", {**ranges, "gamma": search.Uniform(0.2, 1.0), "n_landmarks": [10]}, 3, n_iter=4)
    assert set(best) == {"C", "degree", "kernel", "gamma", "n_landmarks"}
