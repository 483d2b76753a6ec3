"""Spectral regression against the textbook discriminant in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import as_matrix

from jurispark.operators.registry import transformation
from jurispark.operators.spectral import SpectralDiscriminant


def sparse_classes(seed, n, k=7, classes=3):
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(n) % 5 == 0, 0, np.arange(n) % classes)
    X = rng.normal(0, 1, (n, k)) * np.arange(1, k + 1) + rng.normal(0, 2, (classes, k))[y]
    X[rng.random(X.shape) < 0.4] = 0.0
    X[:, 2] += 5.0  # a column without zeros and far from the origin
    return X, y


def dense(X, y, solver, shrinkage=0.0):
    """Class means, covariance within classes and log priors, by definition."""
    groups = [X[y == c] for c in np.unique(y)]
    scatter = sum(len(g) * np.cov(g.T, bias=True) for g in groups)
    cov = scatter / (len(X) - len(groups) if solver == "svd" else len(X))
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / X.shape[1] * np.eye(X.shape[1])
    return np.array([g.mean(0) for g in groups]), cov, np.log([len(g) / len(X) for g in groups])


@pytest.mark.parametrize("solver,shrinkage", [("svd", 0.0), ("lsqr", 0.0), ("eigen", 0.3)])
def test_scores_equal_the_textbook(spark, solver, shrinkage):
    X, y = sparse_classes(0, 90)
    Q, yq = sparse_classes(1, 20)
    Q[4] = 0.0
    model = SpectralDiscriminant(solver, shrinkage=shrinkage).fit(as_matrix(spark, X, y))
    means, cov, priors = dense(X, y, solver, shrinkage)
    inverse = np.linalg.inv(cov)
    want = Q @ inverse @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + priors
    got = {r["id"]: r["scores"] for r in model.decision(as_matrix(spark, Q, yq)).collect()}
    scores = np.array([got[i] for i in range(len(Q))])
    np.testing.assert_allclose(scores - scores[:, :1], want - want[:, :1], atol=1e-4)
    guesses = {r["id"]: r["y_pred"] for r in model.predict(as_matrix(spark, Q, yq)).collect()}
    assert guesses == dict(enumerate(want.argmax(axis=1)))


def test_axes_have_unit_variance_within_classes(spark):
    X, y = sparse_classes(2, 100)
    m = as_matrix(spark, X, y)
    wide = transformation("linearDA").fit(m).transform(m).to_wide(["d1", "d2"]).toPandas()
    Z, labels = wide[["d1", "d2"]].to_numpy(), wide["label"].to_numpy()
    means, cov, _ = dense(Z, labels, "svd")
    np.testing.assert_allclose(cov, np.eye(2), atol=1e-6)
    spread = ((means - Z.mean(0)) ** 2).sum(axis=0)
    assert spread[0] > spread[1]
    one = SpectralDiscriminant(n_components=1).fit(m).transform(m)
    assert {r["feature"] for r in one.cells.select("feature").distinct().collect()} == {"d1"}


def test_more_features_than_rows_and_rows_without_label(spark):
    rng = np.random.default_rng(3)
    X, y = rng.normal(0, 1, (24, 60)), np.arange(24) % 2
    X[:, 0] += 8 * y
    m = as_matrix(spark, X, y)
    # Every row is fitted exactly, so each goes to its own class.
    assert SpectralDiscriminant().fit(m).predict(m).where("label <> y_pred").isEmpty()
    unlabelled = type(m)(m.rows.selectExpr("id", "if(id < 20, label, null) AS label"), m.cells)
    model = SpectralDiscriminant("lsqr", shrinkage=0.5).fit(unlabelled)
    want = SpectralDiscriminant("lsqr", shrinkage=0.5).fit(as_matrix(spark, X[:20], y[:20]))
    np.testing.assert_allclose(model.slopes, want.slopes, atol=1e-6)


def test_what_is_refused(spark):
    for settings in ({"solver": "lu"}, {"shrinkage": 0.5}, {"solver": "lsqr", "shrinkage": 1.0}, {"n_components": 0}):
        with pytest.raises(ValueError):
            SpectralDiscriminant(**settings)
    with pytest.raises(ValueError):
        SpectralDiscriminant().fit(as_matrix(spark, [[1.0], [2.0]], [1, 1]))
    with pytest.raises(ValueError):
        SpectralDiscriminant().fit(as_matrix(spark, [[0.0], [0.0]], [0, 1]).split(
            spark.createDataFrame([(0,), (1,)], "id long"), F.lit(True)))

