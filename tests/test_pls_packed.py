"""The models of a search move packed pieces of columns, not a row per value and model."""

import numpy as np
import pytest
from test_pls import as_matrix, tied_matrix
from test_pls_grid import one_by_one, side_by_side

from jurispark.operators import packed, pls_grid, search, skew
from jurispark.operators.matrix import Matrix
from jurispark.operators.pls import PLS


def test_tables_do_not_grow_with_the_grid(spark, monkeypatch):
    """Ranking residuals writes no ladder of rows x features x models."""
    n, k, sizes = 60, 4, []
    real = pls_grid.materialize

    def counted(df, *more):
        table = real(df, *more)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(pls_grid, "materialize", counted)
    X = np.asarray(tied_matrix(31, n=n, k=k)[0], dtype=float) + np.linspace(1, 2, n)[:, None]
    y = tied_matrix(31, n=n, k=k)[1]
    side_by_side(as_matrix(spark, X, y).written(), {"variant": "gini"})
    assert max(sizes) <= n * k


@pytest.mark.parametrize("variant", ["standard", "gini"])
def test_many_features_blocks_and_ranges(spark, monkeypatch, variant):
    """Two chunks of features, blocks without cells in one of them, columns cut into ranges."""
    X, y = tied_matrix(32, n=36, k=3)
    wide = np.zeros((36, pls_grid.WIDTH + 12))
    rng = np.random.default_rng(32)
    wide[:, :3] = X
    for f in range(3, wide.shape[1]):
        wide[rng.choice(36, 3, replace=False), f] = rng.integers(-3, 4, 3)
    m = as_matrix(spark, wide, y).written()
    monkeypatch.setattr(pls_grid, "LEAST_ROWS", 4)
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 7)
    params = {"variant": variant}
    found = side_by_side(m, params, only_first=True)
    assert found == pytest.approx(one_by_one(m, params))


def test_codes_of_arrays():
    x = np.sort(np.concatenate([np.random.default_rng(33).normal(size=99) * 1e5, [0.0, 1e-300, -1e300]]))
    for kind in ("f8", "planes", "sorted"):
        assert np.array_equal(packed.decoded(packed.coded(x, kind), kind), x)
        assert len(packed.decoded(None, kind)) == 0


def test_parts_of_columns(spark, monkeypatch):
    """Every value in one range of its column, equal values in the same one, ranges in order."""
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 100)
    rng, kinds, rows = np.random.default_rng(34), {"value": "sorted", "s": "planes"}, []
    for block in range(8):
        for c in range(2):
            value = np.sort(rng.integers(0, 60, 75).astype(float))
            rows.append((c, bytearray(packed.coded(value, "sorted")), bytearray(packed.coded(value * 2, "planes"))))
    pieces = spark.createDataFrame(rows, "c int, value binary, s binary")
    found, _, parts = packed.in_parts(pieces, ["c"], kinds, 600, 2)
    assert parts == 6
    got = {}
    for r in found.collect():
        x = packed.arrays(r, kinds)
        assert np.array_equal(x["value"] * 2, x["s"])
        got.setdefault((r["c"], r["part"]), []).extend(x["value"])
    assert sum(map(len, got.values())) == 8 * 2 * 75 and len(got) > 2
    for c in range(2):
        ordered = [got[k] for k in sorted(got) if k[0] == c]
        assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))


def test_undefined_ranks_are_not_skipped(spark):
    """Rows given twice rank beyond the number of rows: such a fold cannot be fitted side by side."""
    X, y = tied_matrix(35, n=24, k=3)
    m = as_matrix(spark, np.asarray(X, dtype=float) + 0.5, y)
    twice = Matrix(m.rows.union(m.rows.where("id < 2")), m.cells.union(m.cells.where("id < 2"))).written()
    marked = search.materialize(search.stratified_folds(twice.rows, 2, "label", "id", 0))
    with pytest.raises(ValueError):
        pls_grid.grid_scores(twice, marked, PLS("gini"), [1.5], [1], [0, 1]).collect()
