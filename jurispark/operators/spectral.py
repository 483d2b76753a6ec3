"""Linear discriminants by spectral regression on sparse cells.

The discriminant directions span the same space as the least-squares regression of the
class indicators on the centred features, so no covariance of features is built: the
regression is solved by conjugate gradients on the cells, all classes in the same passes,
and the discriminant itself is found among its few fitted scores.  The driver holds numbers
per pair of classes, no row and no feature.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize, materialize_with
from .matrix import Matrix
from .skew import weighted_join
from .terms import class_sizes, distinct_labels

log = logging.getLogger(__name__)
SOLVERS = ("svd", "lsqr", "eigen")
# Share of the scores' total variance added to the variance within classes, so that rows
# which the regression fits exactly are still told apart by the nearest class mean.
FLOOR = 1e-14


def _array(width: int, entry) -> Column:
    return F.array(*[entry(j) for j in range(width)])


@dataclass(frozen=True)
class SpectralDiscriminant:
    """One covariance for all classes.

    ``solver`` says how that covariance is scaled: 'svd' divides by n minus the number of
    classes and takes no shrinkage; 'lsqr' and 'eigen' divide by n.  ``shrinkage`` in [0, 1)
    moves it towards its mean variance times the identity.  ``n_components`` limits the new
    features of ``transform`` (at most the number of classes less one), not the predictions.

    Rows without a label are left out; features without a nonzero cell count for nothing.
    The regression ends when its gradient is ``tol`` of the first one in every class, else
    after ``max_iter`` passes with a warning.  With more features than rows it is the
    solution of smallest norm.
    """

    solver: str = "svd"
    n_components: int | None = None
    shrinkage: float = 0.0
    tol: float = 1e-9
    max_iter: int = 200

    def __post_init__(self) -> None:
        if self.solver not in SOLVERS:
            raise ValueError(f"unknown solver {self.solver!r}; known: {SOLVERS}")
        if not 0 <= self.shrinkage < 1:
            raise ValueError("shrinkage must be in [0, 1)")
        if self.shrinkage and self.solver == "svd":
            raise ValueError("the solver 'svd' takes no shrinkage")
        if self.n_components is not None and self.n_components < 1:
            raise ValueError("n_components must be at least 1")

    def fit(self, matrix: Matrix) -> SpectralDiscriminantModel:
        classes = distinct_labels(matrix.rows)
        if len(classes) < 2:
            raise ValueError(f"need at least 2 classes, got {classes}")
        told = matrix.rows.where(F.col("label").isNotNull())
        sizes = class_sizes(told, "label", classes)
        n = sizes[None]
        # The indicators sum to 1, so the first class follows from the others.
        y = [(F.col("label") == F.lit(c)).cast("double") - sizes[c] / n for c in classes[1:]]
        rows = materialize(told.select("id", "label", F.array(*y).alias("r")))
        cells = materialize(matrix.cells.where("value <> 0").join(rows.select("id", "label"), "id"))
        side, seen = materialize_with(
            self._features(cells, classes, sizes),
            F.count(F.lit(1)).alias("k"), F.sum("within").alias("within"),
        )
        if not seen["k"]:
            raise ValueError("the matrix has no nonzero cell")
        ridge = 0.0
        if self.shrinkage:
            ridge = self.shrinkage / (1 - self.shrinkage) * max(seen["within"], 0.0) / seen["k"]
        solved = self._regress(rows, cells.drop("label"), side.drop("within"), seen["k"], len(y), ridge)
        return self._discriminate(*solved, classes, sizes, ridge)

    @staticmethod
    def _features(cells: DataFrame, classes: list, sizes: dict) -> DataFrame:
        """(feature, nnz, mean, within): ``within`` is the sum of squares inside the classes."""
        per_class = cells.groupBy("feature", "label").agg(
            F.count(F.lit(1)).alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
        )
        size = F.element_at(
            F.create_map(*[F.lit(x) for c in classes for x in (c, float(sizes[c]))]), F.col("label")
        )
        # The zeros of a class add to the squares as the parallel formula says.
        squares = F.col("k") * F.col("v") + F.col("m") * F.col("m") * F.col("k") * (size - F.col("k")) / size
        return per_class.groupBy("feature").agg(
            F.sum("k").alias("nnz"),
            (F.sum(F.col("k") * F.col("m")) / float(sizes[None])).alias("mean"),
            F.sum(squares).alias("within"),
        )

    def _regress(
        self, rows: DataFrame, cells: DataFrame, side: DataFrame, size: int, width: int, ridge: float
    ) -> tuple[DataFrame, DataFrame, np.ndarray]:
        """(id, label, r) with the residuals, (feature, nnz, mean, b) and b'b."""
        each = range(width)
        gradient = lambda left, sums: F.coalesce(F.col(sums)[left], F.lit(0.0))

        def step(rows: DataFrame, side: DataFrame, r_sums) -> tuple[DataFrame, dict]:
            """Gradient s of the squared error, next to the last direction and the estimate."""
            sums = cells.join(rows.select("id", "r"), "id").groupBy("feature").agg(
                _array(width, lambda j: F.sum(F.col("value") * F.col("r")[j])).alias("_s")
            )
            s = _array(width, lambda j: gradient(j, "_s") - F.col("mean") * float(r_sums[j]) - ridge * F.col("b")[j])
            table = side.join(sums, "feature", "left").select("feature", "nnz", "mean", "b", "p", s.alias("s"))
            return materialize_with(
                table,
                *[F.sum(F.col("s")[j] * F.col("s")[j]).alias(f"ss{j}") for j in each],
                *[F.sum(F.col("s")[j] * F.col("p")[j]).alias(f"sp{j}") for j in each],
                *[F.sum(F.col("s")[j] * F.col("mean")).alias(f"ms{j}") for j in each],
            )

        def numbers(seen: dict, name: str) -> np.ndarray:
            return np.array([seen[f"{name}{j}"] or 0.0 for j in each])

        zeros = F.array(*[F.lit(0.0)] * width)
        r_sums, beta = np.zeros(width), np.zeros(width)
        mp, pp = np.zeros(width), np.zeros(width)  # mean * p and p * p, summed over features
        side, seen = step(rows, side.withColumn("b", zeros).withColumn("p", zeros), r_sums)
        ss = first = numbers(seen, "ss")
        for _ in range(self.max_iter):
            if np.all(np.sqrt(ss) <= self.tol * np.sqrt(first)):
                break
            mp = numbers(seen, "ms") + beta * mp
            pp = ss + 2 * beta * numbers(seen, "sp") + beta * beta * pp
            p = _array(width, lambda j: F.col("s")[j] + float(beta[j]) * F.col("p")[j])
            side = side.select("feature", "nnz", "mean", "b", p.alias("p"))
            sums = weighted_join(
                cells, side.select("feature", "nnz", "p"), ["feature"], "nnz", ["id"], size
            ).groupBy("id").agg(_array(width, lambda j: F.sum(F.col("value") * F.col("p")[j])).alias("_q"))
            q = _array(width, lambda j: gradient(j, "_q") - float(mp[j]))
            moved, seen = materialize_with(
                rows.join(sums, "id", "left").select("id", "label", "r", q.alias("q")),
                *[F.sum(F.col("q")[j] * F.col("q")[j]).alias(f"qq{j}") for j in each],
                *[F.sum(F.col("q")[j]).alias(f"q{j}") for j in each],
            )
            bottom = numbers(seen, "qq") + ridge * pp
            # A class that has settled stands still.
            alpha = np.divide(ss, bottom, out=np.zeros(width), where=(bottom > 0) & (ss > 0))
            r_sums = r_sums - alpha * numbers(seen, "q")
            rows = moved.select(
                "id", "label", _array(width, lambda j: F.col("r")[j] - float(alpha[j]) * F.col("q")[j]).alias("r")
            )
            b = _array(width, lambda j: F.col("b")[j] + float(alpha[j]) * F.col("p")[j])
            side, seen = step(rows, side.select("feature", "nnz", "mean", b.alias("b"), "p"), r_sums)
            grown = numbers(seen, "ss")
            beta = np.divide(grown, ss, out=np.zeros(width), where=ss > 0)
            ss = grown
        else:
            log.warning("the regression still moved after %d passes", self.max_iter)
        squares = side.agg(*[F.sum(F.col("b")[i] * F.col("b")[j]) for i in each for j in each]).first()
        return rows, side.select("feature", "nnz", "mean", "b"), np.array(squares, dtype=float).reshape(width, width)

    def _discriminate(
        self, rows: DataFrame, side: DataFrame, squares: np.ndarray, classes: list, sizes: dict, ridge: float
    ) -> SpectralDiscriminantModel:
        """The discriminant of the fitted scores, which are indicators minus residuals."""
        width, n = len(classes) - 1, sizes[None]
        fitted = rows.select("label", _array(width, lambda j: (
            (F.col("label") == F.lit(classes[j + 1])).cast("double") - sizes[classes[j + 1]] / n - F.col("r")[j]
        )).alias("z"))
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        found = fitted.groupBy("label").agg(
            *[F.avg(F.col("z")[j]).alias(f"m{j}") for j in range(width)],
            *[F.covar_pop(F.col("z")[i], F.col("z")[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).collect()  # one row per class
        by_class = {row["label"]: row for row in found}
        counts = np.array([sizes[c] for c in classes], dtype=float)
        means = np.array([[by_class[c][f"m{j}"] for j in range(width)] for c in classes])
        within = np.zeros((width, width))
        for c, size in zip(classes, counts):
            for i, j in pairs:
                within[i, j] += size * by_class[c][f"c{i}_{j}"]
        within = within + np.triu(within, 1).T
        between = (means * counts[:, None]).T @ means  # the scores have mean 0
        divisor = n - len(classes) if self.solver == "svd" else n
        floor = FLOOR * np.trace(within + between) / n * np.eye(width)
        covariance = (1 - self.shrinkage) * (within + ridge * squares) / max(divisor, 1) + floor
        inverse = np.linalg.pinv(covariance)
        offset = side.agg(*[F.sum(F.col("mean") * F.col("b")[j]) for j in range(width)]).first()
        # Axes: directions of the class means once the variance within classes is the identity.
        values, turned = np.linalg.eigh(inverse)
        root = (turned * np.sqrt(np.maximum(values, 0))) @ turned.T
        _, turned = np.linalg.eigh(root @ between @ root)
        axes = (root @ turned)[:, ::-1][:, : min(self.n_components or width, width)]
        placed = means @ axes
        largest = placed[np.abs(placed).argmax(axis=0), range(placed.shape[1])]
        return SpectralDiscriminantModel(
            table=materialize(side.select("feature", "nnz", "b")),
            n_features=side.count(),
            classes=classes,
            offset=[float(x or 0.0) for x in offset],
            slopes=(means @ inverse).tolist(),
            constants=(np.log(counts / n) - 0.5 * ((means @ inverse) * means).sum(axis=1)).tolist(),
            axes=(axes * np.where(largest < 0, -1.0, 1.0)).T.tolist(),
        )


@dataclass(frozen=True)
class SpectralDiscriminantModel:
    """Regression coefficients as a table (feature, nnz, b), and per class a line over the scores."""

    table: DataFrame
    n_features: int
    classes: list
    offset: list[float]
    slopes: list[list[float]]
    constants: list[float]
    axes: list[list[float]]

    def _scores(self, matrix: Matrix) -> DataFrame:
        """(id, label, z): regression scores; unknown features drop out, empty rows are all zeros."""
        width = len(self.offset)
        sums = weighted_join(
            matrix.cells.where("value <> 0"), self.table, ["feature"], "nnz", ["id"], self.n_features
        ).groupBy("id").agg(_array(width, lambda j: F.sum(F.col("value") * F.col("b")[j])).alias("_z"))
        z = _array(width, lambda j: F.coalesce(F.col("_z")[j], F.lit(0.0)) - self.offset[j])
        return matrix.rows.join(sums, "id", "left").select("id", "label", z.alias("z"))

    @staticmethod
    def _line(factors: list[float], constant: float = 0.0) -> Column:
        return sum((F.col("z")[j] * float(x) for j, x in enumerate(factors)), F.lit(float(constant)))

    def decision(self, matrix: Matrix) -> DataFrame:
        """(id, label, scores): log posterior of each class, up to what the classes share."""
        lines = [self._line(s, c) for s, c in zip(self.slopes, self.constants)]
        return self._scores(matrix).select("id", "label", F.array(*lines).alias("scores"))

    def predict(self, matrix: Matrix) -> DataFrame:
        best = F.array_position("scores", F.array_max("scores"))
        names = F.array(*[F.lit(c) for c in self.classes])
        return self.decision(matrix).select(
            "id", "label", F.get(names, (best - 1).cast("int")).alias("y_pred")
        )

    def transform(self, matrix: Matrix) -> Matrix:
        """Rows on the discriminant axes d1, d2, ..., the one that parts the classes most first."""
        table = self._scores(matrix)
        entries = F.array(
            *[
                F.struct(F.lit(f"d{i + 1}").alias("feature"), self._line(a).alias("value"))
                for i, a in enumerate(self.axes)
            ]
        )
        return Matrix(
            table.select("id", "label"), table.select("id", F.inline(entries)).where("value <> 0")
        )
