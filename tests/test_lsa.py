"""Truncated singular value decomposition against numpy."""

from pathlib import Path

import numpy as np
import pytest
from test_pls import as_matrix

from jurispark.operators import lsa, skew
from jurispark.operators.lsa import LatentSemantics, tall_factor
from jurispark.operators.matrix import Matrix
from jurispark.sources import scratch


def dense(rows, k, decay, seed):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(rows, k)) * decay ** np.arange(k)
    X[rng.random(X.shape) < 0.3] = 0.0
    return X


def test_values_directions_and_projection(spark):
    X = dense(80, 40, 0.8, 1)
    m = as_matrix(spark, X, np.arange(80) % 2)
    model = LatentSemantics(3).fit(m)
    _, s, turned = np.linalg.svd(X, full_matrices=False)
    np.testing.assert_allclose(model.values, s[:3], rtol=1e-7)
    V = np.zeros((40, 3))
    for r in model.table.collect():
        V[int(r["feature"][1:])] = [r["s1"], r["s2"], r["s3"]]
    assert (V[np.abs(V).argmax(axis=0), range(3)] > 0).all()
    np.testing.assert_allclose(np.abs((V * turned[:3].T).sum(axis=0)), 1.0, atol=1e-6)
    wide = model.transform(m).to_wide(["s1", "s2", "s3"]).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(wide[["s1", "s2", "s3"]], X @ V, atol=1e-8)


def test_lower_rank_and_repeated_rows(spark):
    X = np.outer(np.arange(1, 13), np.ones(6))  # rank 1: equal columns, proportional rows
    model = LatentSemantics(4).fit(as_matrix(spark, X, np.arange(12) % 2))
    np.testing.assert_allclose(model.values, [np.linalg.norm(X)])


def test_no_cells(spark):
    with pytest.raises(ValueError):
        LatentSemantics(2).fit(as_matrix(spark, [[1.0], [1.0]], [0, 1]).split(
            spark.createDataFrame([(9,)], "id long"), "id = 9"))


def test_factor_of_many_parts(spark):
    X = np.random.default_rng(2).normal(size=(300, 5))
    table = spark.createDataFrame([(x.tolist(),) for x in X], "x array<double>").repartition(90)
    R = tall_factor(table, "x", 5)
    np.testing.assert_allclose(R.T @ R, X.T @ X, atol=1e-9)


def test_rounds_move_features_of_blocks_and_not_cells(spark, monkeypatch):
    X = dense(90, 30, 0.8, 3)
    m = as_matrix(spark, X, np.arange(90) % 2)
    cells = int((X != 0).sum())
    met = []
    plain = lsa.weighted_join

    def counted(left, right, on, *rest):
        # As for a vocabulary that is too large to broadcast.
        met.append(left.count())
        return plain(left, right.repartition(3), on, *rest)

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(lsa, "SMALL_BLOCK", 400, raising=False)
    monkeypatch.setattr(lsa, "CELLS_PER_PIECE", 50, raising=False)
    monkeypatch.setattr(lsa, "weighted_join", counted)
    model = LatentSemantics(3).fit(m)
    np.testing.assert_allclose(model.values, np.linalg.svd(X, compute_uv=False)[:3], rtol=1e-7)
    assert max(met) <= 30 * 5 < cells
    counts = {r["feature"]: r["nnz"] for r in model.table.collect()}
    assert sum(counts.values()) == cells


def test_repeated_ids_are_one_row(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "id long, label int")
    cells = spark.createDataFrame(
        [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 1.0), (2, "b", 4.0)], "id long, feature string, value double")
    model = LatentSemantics(2).fit(Matrix(rows, cells))
    np.testing.assert_allclose(model.values, np.linalg.svd([[3.0, 1.0], [0.0, 4.0]], compute_uv=False))


def test_disk_of_rounds_is_bounded(spark, monkeypatch):
    """Tables of earlier rounds go, blocks come in batches, and the projection of the fitted matrix moves no cells."""
    X = dense(90, 30, 0.8, 3)
    m = as_matrix(spark, X, np.arange(90) % 2)
    plain = LatentSemantics(3).fit(m)
    monkeypatch.setattr(lsa, "CELLS_PER_BLOCK", 100)
    monkeypatch.setattr(lsa, "BLOCKS_AT_ONCE", 8)
    root, left = scratch.scratch_root(spark).removeprefix("file:"), []
    tables = lambda: {p.parent for p in Path(root).rglob("_SUCCESS")}
    before, round_ = tables(), lsa.tall_factor

    def counted(*args):
        left.append(len(tables() - before))
        return round_(*args)

    monkeypatch.setattr(lsa, "tall_factor", counted)
    model = LatentSemantics(3).fit(m)
    assert len(model.blocks) > 2 and len(left) >= 8
    assert max(left) <= len(model.blocks) + 2  # the directions of two rounds
    assert len(tables() - before) == len(model.blocks) + 1
    assert spark.conf.get(scratch.CLEANUP) == "false"
    np.testing.assert_allclose(model.values, plain.values, rtol=1e-9)
    again = Matrix(m.rows, m.cells)
    got, want = ({(r["id"], r["feature"]): r["value"] for r in model.transform(x).cells.collect()} for x in (m, again))
    assert got.keys() == want.keys() and got == pytest.approx(want)
