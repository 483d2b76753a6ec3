"""Models fitted side by side score as models fitted one by one."""

import numpy as np
import pytest
from test_pls import as_matrix, tied_matrix

from jurispark.operators import pls_grid, search, skew
from jurispark.operators.pls import PLS

NUS, SIZES, FOLDS = [1.2, 1.7], [1, 2, 3], 2


def one_by_one(m, params):
    """{(nu, n_comp, fold): macro F1} of separate fits on the first fold."""
    fold, train, test = search.inner_splits(m, FOLDS, only_first=True)[0]
    out = {}
    for nu in NUS:
        scores = PLS(**{**params, "n_components": max(SIZES), "nu": nu}).fit(train).component_scores(test)
        out.update({(nu, h, fold): scores[h] for h in SIZES})
    return out


def side_by_side(m, params, **more):
    found = search.pls_scores(m, PLS(**params), NUS, SIZES, n_folds=FOLDS, **more).collect()
    return {(r["nu"], r["n_comp"], r["fold"]): r["score"] for r in found}


@pytest.mark.parametrize("params", [
    {"variant": "standard"},
    {"variant": "gini"},
    {"variant": "gini", "standardize": False, "center_ranks": False},
])
def test_scores_equal_separate_fits(spark, params):
    m = as_matrix(spark, *tied_matrix(21, n=36, k=5)).written()
    found = side_by_side(m, params)
    assert len(found) == len(NUS) * len(SIZES) * FOLDS
    assert {k: v for k, v in found.items() if k[2] == 0} == pytest.approx(one_by_one(m, params))


def test_power_zero_has_no_weights(spark):
    """nu = 1: all ranks are equal, every row gets the same class, as in a single fit."""
    X, y = tied_matrix(26, n=24, k=3)
    m = as_matrix(spark, X, y).written()
    found = search.pls_scores(m, PLS("gini"), [1.0, 1.5], [1, 2], n_folds=2).where("nu = 1").collect()
    _, train, test = search.inner_splits(m, 2, only_first=True)[0]
    model = PLS("gini", 1, nu=1.0).fit(train)
    assert model.weights.where("w1 <> 0").count() == 0
    assert {r["score"] for r in found if r["fold"] == 0} == {model.score(test)}


def test_components_of_one_model(spark):
    """Components of training rows and of rows that join them are those of a single fit."""
    X, y = tied_matrix(22, n=30, k=4)
    X = np.asarray(X, dtype=float)
    X[:, 0] += 20  # a column without zeros
    m = as_matrix(spark, X, y).written()
    fold, train, test = search.inner_splits(m, FOLDS)[0]
    model = PLS("gini", 3, nu=1.7).fit(train)
    marked = search.materialize(search.stratified_folds(m.rows, FOLDS, "label", "id", 0))
    kept = []
    grid = pls_grid._Grid(m, marked, PLS("gini"), NUS, [3], range(FOLDS))
    grid._macro_f1 = lambda rows, ts, fits: kept.append((rows, fits))
    grid.scores()
    rows, fits = kept[0]
    np.testing.assert_allclose(fits[2][0, 1][1], model.coefficients[2], rtol=1e-8)
    got = {r["id"]: [r[t][1] for t in ("t1", "t2", "t3")] for r in rows.where("g = 0").collect()}
    for part in (model.train_rows, model.transform(test)):
        for r in part.collect():
            np.testing.assert_allclose(got.pop(r["id"]), [r["t1"], r["t2"], r["t3"]], atol=1e-9)
    assert not got


def test_without_broadcasts(spark, monkeypatch):
    m = as_matrix(spark, *tied_matrix(23, n=24, k=3)).written()
    plain = side_by_side(m, {"variant": "gini"})
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 5)
    assert side_by_side(m, {"variant": "gini"}) == pytest.approx(plain)


def test_first_fold_only_and_fallback(spark, caplog):
    X, y = tied_matrix(24, n=24, k=3)
    m = as_matrix(spark, X, y).written()
    assert {f for _, _, f in side_by_side(m, {"variant": "standard"}, only_first=True)} == {0}
    constant = as_matrix(spark, np.ones((24, 2)), y).written()
    scores = side_by_side(constant, {"variant": "standard"})
    assert len(scores) == len(NUS) * len(SIZES) * FOLDS and set(scores.values()) == {None}


def test_job_count_does_not_grow_with_the_grid(spark):
    """Ten times the settings, the same jobs (counted by their job group)."""
    m = as_matrix(spark, *tied_matrix(25, n=24, k=3)).written()
    sc, counts = spark.sparkContext, []
    for name, nus in (("few", [1.5]), ("many", [1.0 + i / 20 for i in range(1, 11)])):
        sc.setJobGroup(name, name)
        search.pls_scores(m, PLS("gini"), nus, [2], n_folds=2)
        counts.append(len(sc.statusTracker().getJobIdsForGroup(name)))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] * 1.2
