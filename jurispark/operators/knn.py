"""Exact k nearest neighbours without comparing every pair.

Both sides are assigned to the nearest of a few pivot rows.  Distances to the pivots
bound the distance of any train row to any test row of a pivot cell (triangle
inequality), so each train row travels only to the cells where it can be a neighbour.
Cells are then cut into blocks of bounded size on both sides; a task compares one test
block with one train block and hands on the best k of each test row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import shuffle_key, value_bucket
from ..sources.scratch import materialize

METRICS = ("euclidean", "manhattan", "chebyshev")
# Distances of a task that are held at once, and a stretch of them that stays in the cache.
PAIRS_AT_ONCE = 4_000_000
TILE = 32_768
# Vectors with larger numbers (or none at all) are compared one way only, without a bound on rounding.
PLAIN_ABOVE = 1e15
# Tasks that the blocks are dealt out to, at most.
MAX_TASKS = 4_096


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every row of ``a`` to every row of ``b``, in slices of bounded memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, 8_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        gap = np.abs(a[i : i + step, None, :] - b[None, :, :])
        if metric == "euclidean":
            out[i : i + step] = np.sqrt((gap * gap).sum(axis=2))
        elif metric == "manhattan":
            out[i : i + step] = gap.sum(axis=2)
        else:
            out[i : i + step] = gap.max(axis=2)
    return out


def _near_enough(a: np.ndarray, b: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``) of every pair that may be among the k nearest of its row of ``a``.

    Distances are summed in the order that is fastest (a matrix product, or feature by feature in
    single precision on stretches that fit the cache); what that may round differently is allowed
    for, so none is missed.
    """
    width = a.shape[1]
    if metric == "euclidean":
        squares, own = (b * b).sum(axis=1), (a * a).sum(axis=1)
        near = a @ b.T
        near *= -2.0
        near += squares
        near += own[:, None]
        slack = 8 * np.finfo(float).eps * (width + 8) * (own + squares.max())
    else:
        near = np.empty((len(a), len(b)), dtype=np.float32)
        rows, columns = a.astype(np.float32), np.ascontiguousarray(b.T.astype(np.float32))
        merge = np.add if metric == "manhattan" else np.maximum
        total, gap = np.empty(TILE, dtype=np.float32), np.empty(TILE, dtype=np.float32)
        for j in range(0, len(b), TILE):
            part = np.ascontiguousarray(columns[:, j : j + TILE])
            s, g = total[: part.shape[1]], gap[: part.shape[1]]
            for i, row in enumerate(rows):
                s[:] = 0
                for x, column in zip(row, part):
                    np.subtract(column, x, out=g)
                    np.abs(g, out=g)
                    merge(s, g, out=s)
                near[i, j : j + TILE] = s
        largest = max(np.abs(a).max(), np.abs(b).max())
        slack = 8 * np.finfo(np.float32).eps * (width + 8) * width * (largest + 1e-30)
    last = np.partition(near, k - 1, axis=1)[:, k - 1] if k < len(b) else near.max(axis=1)
    return np.nonzero(near <= (last + slack)[:, None])


def nearest_in_block(x: np.ndarray, z: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``x``, row of ``z``, distance): the k nearest rows of ``z``, ties to the earlier row."""
    k = min(k, len(z))
    step = max(1, PAIRS_AT_ONCE // len(z))  # bounds the distance table held at once
    # Rounding is bounded for numbers whose squares and sums stay finite.
    plain = not x.shape[1] or not all((np.abs(side) < PLAIN_ABOVE).all() for side in (x, z))
    out = []
    for i in range(0, len(x), step):
        part = x[i : i + step]
        if plain:
            d = distances(part, z, metric)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append((np.repeat(np.arange(len(part)), k) + i, order.ravel(), np.take_along_axis(d, order, axis=1).ravel()))
            continue
        rows, cols = _near_enough(part, z, k, metric)
        d = np.empty(len(rows))
        few = max(1, 4_000_000 // x.shape[1])
        for j in range(0, len(rows), few):
            gap = np.abs(part[rows[j : j + few]] - z[cols[j : j + few]])
            if metric == "euclidean":
                d[j : j + few] = np.sqrt((gap * gap).sum(axis=1))
            else:
                d[j : j + few] = gap.sum(axis=1) if metric == "manhattan" else gap.max(axis=1)
        order = np.lexsort((cols, d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < k
        out.append((rows[kept] + i, cols[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _to_cells(rows: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``reach`` (distance to it)."""

    @F.pandas_udf("cell int, reach double")
    def nearest(features: pd.Series) -> pd.DataFrame:
        if not len(features):
            return pd.DataFrame({"cell": [], "reach": []})
        d = distances(np.stack(features.to_numpy()), pivots, metric)
        best = d.argmin(axis=1)
        return pd.DataFrame({"cell": best.astype("int32"), "reach": d[np.arange(len(d)), best]})

    return rows.withColumn("_n", nearest("features")).select("*", "_n.cell", "_n.reach").drop("_n")


def _routes(train: DataFrame, test: DataFrame, pivots: np.ndarray, k: int, metric: str):
    """(test cell, train cell, least and greatest reach of train rows that can matter).

    Works on a histogram of reaches per cell: cells times buckets, not rows.
    """
    hist = (
        train.groupBy("cell", value_bucket(F.col("reach")).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r"))
        .toPandas()
    )
    sizes = test.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).toPandas()
    between = distances(pivots, pivots, metric)
    rows, blocks = [], {}
    for cell, n, radius in zip(sizes["cell"], sizes["n"], sizes["r"]):
        bound = between[cell, hist["cell"]] + hist["r"].to_numpy()
        order = np.argsort(bound, kind="stable")
        enough = np.searchsorted(np.cumsum(hist["n"].to_numpy()[order]), k)
        limit = radius + bound[order[min(enough, len(order) - 1)]]
        slack = 1e-9 * (1.0 + limit)
        blocks[int(cell)] = int(n)
        for other in range(len(pivots)):
            gap = between[cell, other]
            rows.append(
                (int(cell), other, float(gap - radius - limit - slack), float(gap + radius + limit + slack))
            )
    return rows, blocks, int(hist["n"].sum())


def nearest_neighbours(
    train: DataFrame,
    test: DataFrame,
    k: int = 5,
    metric: str = "euclidean",
    n_pivots: int = 16,
    block_rows: int = 4_096,
) -> DataFrame:
    """(id, rank, train_id, label, distance): the k nearest train rows of each test row.

    ``train`` is (id, label, features array), ``test`` (id, features array).  Equal
    distances are ordered by train id.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
    spark = train.sparkSession
    chosen = train.orderBy(shuffle_key(0, F.col("id")), "id").limit(n_pivots).select("features")
    pivots = np.array([r[0] for r in chosen.collect()], dtype=float)
    train_cells = materialize(_to_cells(train.select("id", "label", "features"), pivots, metric))
    test_cells = materialize(_to_cells(test.select("id", "features"), pivots, metric))
    routes, sizes, n_train = _routes(train_cells, test_cells, pivots, k, metric)
    train_blocks = max(1, -(-n_train // (block_rows * n_pivots)))
    block_counts = {c: max(1, -(-n // block_rows)) for c, n in sizes.items()}
    route = spark.createDataFrame(
        [(c, o, lo, hi, block_counts[c]) for c, o, lo, hi in routes],
        "test_cell int, cell int, least double, most double, blocks int",
    )
    per_cell = route.select("test_cell", "blocks").distinct()
    hashed = F.xxhash64("id")
    right = (
        train_cells.join(F.broadcast(route), "cell")  # at most n_pivots ** 2 rows
        .where(F.col("reach").between(F.col("least"), F.col("most")))
        .select(
            "test_cell",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(hashed, F.lit(train_blocks)).cast("int").alias("part"),
            F.col("id").alias("train_id"),
            "label",
            "features",
        )
    )
    left = (
        test_cells.withColumnRenamed("cell", "test_cell")
        .join(F.broadcast(per_cell), "test_cell")
        .select(
            "test_cell",
            F.pmod(hashed, F.col("blocks")).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(train_blocks - 1))).alias("part"),
            "id",
            "features",
        )
    )
    kind, label_kind = dict(test.dtypes)["id"], dict(train.dtypes)["label"]
    schema = f"id {kind}, train_id {dict(train.dtypes)['id']}, label {label_kind}, distance double"

    def best(tests: pd.DataFrame, trains: pd.DataFrame) -> pd.DataFrame:
        if tests.empty or trains.empty:
            return pd.DataFrame({"id": [], "train_id": [], "label": [], "distance": []})
        trains = trains.sort_values("train_id")
        x, z = np.stack(tests["features"].to_numpy()), np.stack(trains["features"].to_numpy())
        rows, cols, gaps = nearest_in_block(x, z, k, metric)
        return pd.DataFrame(
            {
                "id": tests["id"].to_numpy()[rows],
                "train_id": trains["train_id"].to_numpy()[cols],
                "label": trains["label"].to_numpy()[cols],
                "distance": gaps,
            }
        )

    keys = ["test_cell", "block", "part"]
    # The work of a block is the product of its sides, not its bytes: a fixed number of partitions
    # keeps adaptive execution from putting many small blocks into one task.
    tasks = min(MAX_TASKS, max(1, sum(block_counts.values()) * train_blocks))
    sides = [side.repartition(tasks, *keys).groupBy(*keys) for side in (left, right)]
    found = sides[0].cogroup(sides[1]).applyInPandas(best, schema)
    order = W.partitionBy("id").orderBy("distance", "train_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("id", "rank", "train_id", "label", "distance")
    )


def vote(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """(id, y_pred): the label with most votes; ties go to the smallest label.

    ``distance`` weighs a vote by 1 / distance; exact matches then outvote all others.
    """
    if weights == "uniform":
        weighed = neighbours.withColumn("_w", F.lit(1.0))
    elif weights == "distance":
        exact = F.max((F.col("distance") == 0).cast("int")).over(W.partitionBy("id"))
        weighed = neighbours.withColumn("_exact", exact).withColumn(
            "_w",
            F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(
                1 / F.col("distance")
            ),
        )
    else:
        raise ValueError(f"unknown weights {weights!r}")
    votes = weighed.groupBy("id", "label").agg(F.sum("_w").alias("_votes"))
    return votes.groupBy("id").agg(
        F.min(F.struct((-F.col("_votes")).alias("v"), F.col("label").alias("l")))["l"].alias("y_pred")
    )


@dataclass(frozen=True)
class Neighbours:
    """k nearest neighbours as a classifier on matrices."""

    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"

    def fit(self, matrix) -> NeighboursModel:
        from .vectors import FeatureSpace

        space = FeatureSpace.of(matrix)
        return NeighboursModel(self, space, materialize(space.arrays(matrix)))


@dataclass(frozen=True)
class NeighboursModel:
    params: Neighbours
    space: object
    train: DataFrame

    def predict(self, matrix) -> DataFrame:
        test = materialize(self.space.arrays(matrix))
        near = nearest_neighbours(
            self.train, test.select("id", "features"), self.params.k, self.params.metric
        )
        return test.select("id", "label").join(vote(near, self.params.weights), "id")
