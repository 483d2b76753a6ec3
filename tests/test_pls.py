import numpy as np
import pytest
from dense_pls import DensePLS

from jurispark.operators.matrix import Matrix
from jurispark.operators.pls import PLS, PLSModel

TRAIN = [
    [0.0, 2.5, 3.0, 7, 1.25, 6.5], [1.0, 0.5, 2.0, 7, 3.5, 0.75], [3.0, 3.0, 0.0, 7, 0.4, 2.2],
    [5.0, 0.0, 3.0, 7, 8.0, 4.1], [2.0, 0.5, 6.0, 7, 3.5, 5.6], [2.5, 1.75, 0.9, 7, 6.3, 6.0],
]
TRAIN_Y = [0, 0, 0, 1, 1, 1]
TEST = [
    [0.6, 0.0, 1.0, 2, 1.25, 3], [2.2, 1.9, 0.7, 6, 5, 7], [3.0, 0.4, 4.5, 7, 0, 1.1],
    [4.1, 2.0, 2.4, 9, 9.5, 8], [1.0, 1.6, 1.2, 0, 12.5, 11.8],
]
TEST_Y = [1, 0, 0, 1, 1]


def as_matrix(spark, X, y):
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, label int")
    cells = spark.createDataFrame(
        [(i, f"f{j}", float(v)) for i, r in enumerate(X) for j, v in enumerate(r) if v != 0],
        "id long, feature string, value double",
    )
    return Matrix(rows, cells)


def check(spark, X, y, Xt, yt, variant, h, nu, tol, **more):
    dense = DensePLS(variant, h, nu, **{"std": True, "center": True, **more}).fit(X, y)
    spark_settings = {"standardize": more.get("std", True), "center_ranks": more.get("center", True)}
    model = PLS(variant, h, nu, **spark_settings).fit(as_matrix(spark, X, y))
    got = {r["feature"]: r for r in model.weights.collect()}
    for j in range(h):
        want = {f"f{f}": dense.W[j][i] for i, f in enumerate(dense.keep)}
        assert set(want) == set(got)
        for f, w in want.items():
            assert got[f][f"w{j + 1}"] == pytest.approx(w, abs=tol)
    rows = sorted(model.train_rows.collect(), key=lambda r: r["id"])
    T = np.array([[r[t] for t in model.components] for r in rows])
    np.testing.assert_allclose(T, dense.T, atol=tol * 100)
    test = as_matrix(spark, Xt, yt)
    rows = sorted(model.transform(test).collect(), key=lambda r: r["id"])
    T = np.array([[r[t] for t in model.components] for r in rows])
    np.testing.assert_allclose(T, dense.transform(Xt), atol=tol * 100)
    scores = dense.transform(Xt) @ dense.c
    preds = sorted(model.predict(test).collect(), key=lambda r: r["id"])
    np.testing.assert_allclose([r["score"] for r in preds], scores, atol=tol * 100)
    assert [r["y_pred"] for r in preds] == [int(s >= dense.threshold) for s in scores]
    return dense, model


@pytest.mark.parametrize(
    "variant,h,nu,tol",
    [
        ("standard", 3, 2.0, 1e-9),
        ("gini", 3, 1.7, 1e-9),
        ("gini", 2, 3.0, 1e-9),
        ("logit", 2, 2.0, 1e-6),
        ("logit_gini", 2, 1.3, 1e-6),
    ],
)
def test_small_matrix(spark, variant, h, nu, tol):
    check(spark, TRAIN, TRAIN_Y, TEST, TEST_Y, variant, h, nu, tol)


def tied_matrix(seed, n=60, k=8):
    """Small integers, half of them 0, one constant column."""
    rng = np.random.default_rng(seed)
    X = rng.integers(0, 5, (n, k)) * (rng.random((n, k)) < 0.5)
    X[:, 2] = 3
    y = (X[:, 0] + rng.normal(0, 1, n) > 1).astype(int)
    return X, y


@pytest.mark.parametrize(
    "variant,h,tol", [("standard", 3, 1e-8), ("gini", 2, 1e-8), ("logit_gini", 2, 1e-6)]
)
def test_ties_and_zeros(spark, variant, h, tol):
    X, y = tied_matrix(1)
    Xt, yt = tied_matrix(2, n=12)
    check(spark, X, y, Xt, yt, variant, h, 1.7, tol)


def test_raw_values_and_uncentred_ranks(spark):
    X, y = tied_matrix(3)
    Xt, yt = tied_matrix(4, n=10)
    check(spark, X, y, Xt, yt, "standard", 2, 2.0, 1e-8, std=False)
    check(spark, X, y, Xt, yt, "gini", 2, 1.5, 1e-8, center=False)


def test_fit_statistics_by_leaving_rows_out(spark):
    X, y = tied_matrix(5, n=40)
    dense, model = check(spark, X, y, X[:5], y[:5], "standard", 2, 2.0, 1e-8)
    table = sorted(model.fit_table(spark).collect(), key=lambda r: r["component"])
    for j in (1, 2):
        T = dense.T[:, :j]
        rss = ((dense.ys - T @ (np.linalg.pinv(T) @ dense.ys)) ** 2).sum()
        assert table[j - 1]["rss"] == pytest.approx(rss)
        assert table[j - 1]["press"] == pytest.approx(dense.press(j))
        total = (dense.ys**2).sum() if j == 1 else rss
        assert table[j - 1]["q2"] == pytest.approx(1 - dense.press(j) / total)
    want = dense.vip()
    got = {r["feature"]: r for r in model.vip().collect()}
    for i, f in enumerate(dense.keep):
        assert got[f"f{f}"]["vip1"] == pytest.approx(want[i, 0])
        assert got[f"f{f}"]["vip2"] == pytest.approx(want[i, 1])
    assert abs(dense.T[:, 0] @ dense.T[:, 1]) < 1e-8


@pytest.mark.parametrize("variant", ["standard", "logit"])
def test_backward_elimination(spark, variant):
    X, y = tied_matrix(6)
    model = PLS(variant, 2, use_vip=True).fit(as_matrix(spark, X, y))
    cols = list(range(X.shape[1]))
    cols.remove(2)
    while True:
        dense = DensePLS(variant, 2).fit(X[:, cols], y)
        keep = [c for c, v in zip(cols, dense.vip().sum(1)) if v >= 1]
        if len(keep) < 2 or len(keep) == len(cols):
            break
        cols = keep
    assert {r["feature"] for r in model.weights.collect()} == {f"f{c}" for c in cols}


def test_flat_ranks_give_zero_weights(spark):
    model = PLS("gini", 1, nu=1.0).fit(as_matrix(spark, TRAIN, TRAIN_Y))
    assert all(r["w1"] == 0 for r in model.weights.collect())


def test_wrong_settings_are_refused(spark):
    for bad in ({"variant": "other"}, {"n_components": 0}, {"nu": 0.0}):
        with pytest.raises(ValueError):
            PLS(**bad)
    with pytest.raises(ValueError):
        PLS().fit(as_matrix(spark, TRAIN, [0, 1, 2, 0, 1, 2]))


def test_model_round_trip(spark, tmp_path):
    model = PLS("gini", 2, nu=1.7).fit(as_matrix(spark, TRAIN, TRAIN_Y))
    model.save(str(tmp_path / "m"))
    again = PLSModel.load(spark, str(tmp_path / "m"))
    test = as_matrix(spark, TEST, TEST_Y)
    assert sorted(model.predict(test).collect()) == sorted(again.predict(test).collect())
    assert 0.0 <= again.score(test) <= 1.0


@pytest.mark.parametrize("variant", ["standard", "gini"])
def test_first_components_equal_a_smaller_fit(spark, variant):
    X, y = tied_matrix(7)
    train, test = as_matrix(spark, X, y), as_matrix(spark, *tied_matrix(8, n=15))
    large = PLS(variant, 3, nu=1.5).fit(train)
    small = PLS(variant, 2, nu=1.5).fit(train)
    a = sorted(large.first(2).predict(test).collect(), key=lambda r: r["id"])
    b = sorted(small.predict(test).collect(), key=lambda r: r["id"])
    np.testing.assert_allclose([r["score"] for r in a], [r["score"] for r in b], atol=1e-9)
    assert large.component_scores(test)[2] == pytest.approx(small.score(test))


@pytest.mark.parametrize("variant,tol", [("standard", 1e-8), ("gini", 1e-8), ("logit_gini", 1e-6)])
def test_without_broadcasts(spark, monkeypatch, variant, tol):
    """The joins used for models too large to broadcast, with keys cut into slices."""
    from jurispark.operators import pls, skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pls, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 5)
    X, y = tied_matrix(9, n=30, k=5)
    Xt, yt = tied_matrix(10, n=8, k=5)
    check(spark, X, y, Xt, yt, variant, 2, 1.7, tol)
