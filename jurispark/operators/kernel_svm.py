"""Support vector machines with kernels, on a bounded set of landmark rows.

The decision is f(x) = sum_k a_k K(x, l_k) + b over landmarks l_k, the rows that come first in a
seeded order.  It minimises a' K a / 2 + C sum max(0, 1 - y f(x))^2, which is the squared-hinge
machine in the landmark (Nystroem) feature space.

Inner products of all rows with the landmarks are taken once; every kernel is a function of them
and of the squared lengths.  A Newton step of all models (settings x folds x classes) is one pass
over that table: each task adds up gradients and curvatures of the rows inside the margin, Spark
sums them per model, and the driver solves systems of the size of the landmarks.  So a search
takes as many jobs as its slowest model takes steps, however many settings it has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import shuffle_key
from ..sources.scratch import materialize
from .folds import clamped_fold_count, stratified_folds
from .matrix import Matrix
from .terms import distinct_labels

KERNELS = ("linear", "poly", "rbf", "sigmoid")
LANDMARKS = 256
SEARCH_LANDMARKS = 64
ROWS = 2_000  # rows that a task looks at together
MAX_STEPS = 50
TOLERANCE = 1e-10
RIDGE = 1e-9  # of the mean curvature: keeps repeated landmarks apart


@dataclass(frozen=True)
class KernelSVM:
    """Settings; ``fit`` returns the model.  ``gamma`` is a number, or "scale" for
    1 / (features x variance of all values, zeros included).

    Several classes are told apart one against the rest.  Repeated landmarks are harmless; with
    fewer rows than landmarks all rows are landmarks.
    """

    kernel: str = "rbf"
    C: float = 1.0
    gamma: float | str = "scale"
    degree: int = 3
    coef0: float = 0.0
    n_landmarks: int = LANDMARKS
    seed: int = 0

    def __post_init__(self) -> None:
        if self.kernel not in KERNELS:
            raise ValueError(f"unknown kernel {self.kernel!r}; known: {KERNELS}")
        if self.C <= 0 or self.n_landmarks < 1:
            raise ValueError("C must be positive, n_landmarks at least 1")
        if isinstance(self.gamma, str) and self.gamma != "scale":
            raise ValueError('gamma is a number or "scale"')

    def fit(self, matrix: Matrix) -> KernelSVMModel:
        classes = distinct_labels(matrix.rows)
        if len(classes) < 2:
            raise ValueError(f"need at least 2 classes, got {classes}")
        params = self.resolved(matrix)
        landmarks = Landmarks.of(matrix, self.n_landmarks, self.seed)
        table = materialize(landmarks.products(matrix.rows.withColumn("fold", F.lit(-1)), matrix.cells))
        models = [Task(0, -2, k) for k in range(1 if len(classes) == 2 else len(classes))]
        weights = newton(table, landmarks, [params], models, classes)
        return KernelSVMModel(params, classes, landmarks, np.stack([weights[m] for m in models]))

    def resolved(self, matrix: Matrix) -> KernelSVM:
        """The same settings with a number for ``gamma``."""
        return replace(self, gamma=scale(matrix)) if self.gamma == "scale" else self

    def of_products(self, dots: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Kernel values from inner products and the squared lengths of rows and landmarks."""
        if self.kernel == "linear":
            return dots
        if self.kernel == "rbf":
            return np.exp(-self.gamma * np.maximum(lengths[:, None] + own - 2 * dots, 0))
        inner = self.gamma * dots + self.coef0
        return inner**self.degree if self.kernel == "poly" else np.tanh(inner)


def scale(matrix: Matrix) -> float:
    """1 / (features x variance of all values); 1 if nothing varies."""
    cells = matrix.cells.where("value <> 0")
    got = cells.agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")
    ).first()
    features = cells.select("feature").distinct().count()
    n = matrix.rows.count() * features
    if not n:
        return 1.0
    variance = got["ss"] / n - (got["s"] / n) ** 2
    return 1.0 / (features * variance) if variance > 0 else 1.0


@dataclass(frozen=True)
class Landmarks:
    """Cells of the landmark rows, ordered by feature: bounded by the number of landmarks."""

    size: int
    features: list
    starts: np.ndarray
    numbers: np.ndarray
    values: np.ndarray
    lengths: np.ndarray  # squared, per landmark

    @staticmethod
    def of(matrix: Matrix, n: int, seed: int = 0) -> Landmarks:
        """The first ``n`` rows in seeded order."""
        key = shuffle_key(seed, F.col("id"))
        chosen = [r["id"] for r in matrix.rows.orderBy(key, "id").limit(n).select("id").collect()]
        kind = matrix.rows.schema["id"].dataType
        named = matrix.rows.sparkSession.createDataFrame(
            list(enumerate(chosen)), f"number int, id {kind.simpleString()}"
        )
        cells = matrix.cells.where("value <> 0").join(F.broadcast(named), "id")
        got = sorted(
            ((r["feature"], r["number"], float(r["value"])) for r in cells.select("feature", "number", "value").collect())
        )
        features, starts = [], []
        for i, (f, _, _) in enumerate(got):
            if not features or features[-1] != f:
                features.append(f)
                starts.append(i)
        numbers = np.array([x[1] for x in got], np.int64)
        values = np.array([x[2] for x in got])
        lengths = np.bincount(numbers, values**2, len(chosen)) if len(got) else np.zeros(len(chosen))
        return Landmarks(len(chosen), features, np.array([*starts, len(got)], np.int64), numbers, values, lengths)

    def dots(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Inner products of sparse rows (cells with numbers of known features) with all landmarks."""
        many = np.diff(self.starts)[feature]
        first = np.repeat(self.starts[feature] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        place = np.repeat(row, many) * self.size + self.numbers[first]
        weight = np.repeat(value, many) * self.values[first]
        return np.bincount(place, weight, rows * self.size).reshape(rows, self.size)

    def between(self) -> np.ndarray:
        """Inner products of the landmarks with one another."""
        feature = np.repeat(np.arange(len(self.features)), np.diff(self.starts))
        return self.dots(self.numbers, feature, self.values, self.size)

    def products(self, rows: DataFrame, cells: DataFrame) -> DataFrame:
        """(columns of ``rows``, length, dots): squared length and inner products of each row."""
        packed = cells.where("value <> 0").groupBy("id").agg(
            F.collect_list(F.struct("feature", F.col("value").cast("double").alias("value"))).alias("cells")
        )
        table = rows.join(packed, "id", "left")
        names = rows.columns
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = {f: i for i, f in enumerate(self.features)}
            for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
                lists = batch.column("cells")
                flat = lists.flatten()
                many = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array(
                    [len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64
                )
                owner = np.repeat(np.arange(batch.num_rows), many)
                value = flat.field("value").to_numpy(zero_copy_only=False)
                known = np.array([number.get(f, -1) for f in flat.field("feature").to_pylist()], np.int64)
                length = np.bincount(owner, value**2, batch.num_rows)
                told = known >= 0
                dots = self.dots(owner[told], known[told], value[told], batch.num_rows)
                packed = pa.ListArray.from_arrays(
                    np.arange(0, dots.size + 1, max(1, self.size), dtype=np.int32), pa.array(dots.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(length), packed], [*names, "length", "dots"]
                )

        return table.mapInArrow(run, f"{kinds}, length double, dots array<double>")


@dataclass(frozen=True)
class Task:
    """One model to fit: a setting, the fold it is not trained on, and the class it speaks for."""

    setting: int
    fold: int
    k: int


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        dots = batch.column("dots").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        yield batch, dots, batch.column("length").to_numpy(zero_copy_only=False)


def _targets(labels: list, classes: list, k: int) -> np.ndarray:
    """1 for the class that model ``k`` speaks for, else -1; of two classes it is the larger."""
    mine = classes[1] if len(classes) == 2 else classes[k]
    return np.array([1.0 if x == mine else -1.0 for x in labels])


def _sums(
    table: DataFrame, landmarks: Landmarks, settings: Sequence[KernelSVM], classes: list,
    current: dict[Task, np.ndarray],
) -> dict[Task, tuple[float, np.ndarray, np.ndarray]]:
    """Per model: summed loss, sum of y k and sum of k k' over the rows inside its margin."""
    tasks = list(current)
    size = landmarks.size + 1

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(1 + size + size * size) for i in range(len(tasks))}
        for batch, dots, lengths in _blocks(batches):
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_pylist()
            signs = {k: _targets(labels, classes, k) for k in {t.k for t in tasks}}
            for s in sorted({t.setting for t in tasks}):
                kernel = settings[s].of_products(dots, lengths, landmarks.lengths)
                kernel = np.hstack([kernel, np.ones((len(kernel), 1))])
                for i, t in enumerate(tasks):
                    if t.setting != s:
                        continue
                    y = signs[t.k]
                    gap = 1 - y * (kernel @ current[t])
                    inside = (gap > 0) & (fold != t.fold)
                    part = kernel[inside]
                    total[i][0] += (gap[inside] ** 2).sum()
                    total[i][1 : 1 + size] += y[inside] @ part
                    total[i][1 + size :] += (part.T @ part).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            ["task", "sums"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("task").to_pylist(), batch.column("sums"), strict=True):
                x = np.frombuffer(x.as_buffer())
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            ["task", "sums"],
        )

    schema = "task int, sums binary"
    found = table.mapInArrow(learn, schema).repartition(min(len(tasks), 64), "task").mapInArrow(add, schema)
    out = {}
    for r in found.collect():  # one row per model, bounded by the landmarks
        x = np.frombuffer(r["sums"])
        out[tasks[r["task"]]] = float(x[0]), x[1 : 1 + size], x[1 + size :].reshape(size, size)
    return out


def newton(
    table: DataFrame, landmarks: Landmarks, settings: Sequence[KernelSVM], tasks: Sequence[Task], classes: list
) -> dict[Task, np.ndarray]:
    """Weights (landmarks, then the constant) of every model; one pass over ``table`` a step.

    A step that does not lower the objective is halved.  Settled models leave the passes.
    """
    size = landmarks.size + 1
    penalties = []
    for s in settings:
        own = s.of_products(landmarks.between(), landmarks.lengths, landmarks.lengths)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        whole = np.zeros((size, size))
        whole[:-1, :-1] = (vectors * np.maximum(values, 0)) @ vectors.T  # a sigmoid may be indefinite
        penalties.append(whole)
    current = {t: np.zeros(size) for t in tasks}
    best: dict[Task, tuple[float, np.ndarray]] = {}
    done: dict[Task, np.ndarray] = {}
    for _ in range(MAX_STEPS):
        moved = {}
        for t, (loss, slope, curve) in _sums(table, landmarks, settings, classes, current).items():
            c, penalty, w = settings[t.setting].C, penalties[t.setting], current[t]
            value = float(w @ penalty @ w) / 2 + c * loss
            if t in best and value > best[t][0] * (1 + 1e-12):
                middle = (best[t][1] + w) / 2
                if np.abs(middle - best[t][1]).max() < TOLERANCE * max(1.0, np.abs(middle).max()):
                    done[t] = best[t][1]
                else:
                    moved[t] = middle
                continue
            best[t] = value, w
            whole = penalty + 2 * c * curve
            ridge = RIDGE * np.trace(whole) / size if np.linalg.matrix_rank(whole) < size else 0.0
            after = np.linalg.solve(whole + (ridge or 1e-300) * np.eye(size), 2 * c * slope)
            if np.abs(after - w).max() < TOLERANCE * max(1.0, np.abs(after).max()):
                done[t] = after
            else:
                moved[t] = after
        current = moved
        if not current:
            break
    return {**{t: best[t][1] for t in current}, **done}


@dataclass(frozen=True)
class KernelSVMModel:
    params: KernelSVM
    classes: list
    landmarks: Landmarks
    weights: np.ndarray  # models x (landmarks + 1)

    def decision(self, matrix: Matrix) -> DataFrame:
        """(id, label, margins): f(x) of each model; one model for two classes."""
        table = self.landmarks.products(matrix.rows.select("id", "label"), matrix.cells)
        params, landmarks, weights = self.params, self.landmarks, self.weights
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in ("id", "label"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, dots, lengths in _blocks(batches):
                kernel = params.of_products(dots, lengths, landmarks.lengths)
                found = kernel @ weights[:, :-1].T + weights[:, -1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array(list(found), pa.list_(pa.float64()))],
                    ["id", "label", "margins"],
                )

        return table.mapInArrow(run, f"{kinds}, margins array<double>")

    def predict(self, matrix: Matrix) -> DataFrame:
        """(id, label, y_pred): of two classes the larger where the margin is not negative."""
        names = F.array(*[F.lit(c) for c in self.classes])
        if len(self.classes) == 2:
            index = (F.col("margins")[0] >= 0).cast("int")
        else:
            index = (F.array_position("margins", F.array_max("margins")) - 1).cast("int")
        return self.decision(matrix).select("id", "label", F.get(names, index).alias("y_pred"))


def score_candidates(
    matrix: Matrix, candidates: Sequence[dict], n_folds: int = 5, seed: int = 0
) -> DataFrame:
    """(params, fold, score): accuracy of each candidate, written as JSON, on each fold.

    All candidates share landmarks and inner products; their models are fitted side by side.
    ``n_landmarks`` and ``seed`` must be the same for all.  Rows without a label take no part.
    """
    spark = matrix.rows.sparkSession
    settings = [KernelSVM(**{"n_landmarks": SEARCH_LANDMARKS, **c}) for c in candidates]
    if len({(s.n_landmarks, s.seed) for s in settings}) > 1:
        raise ValueError("candidates of a search share their landmarks")
    schema = "params string, fold int, score double"
    if not settings:
        return spark.createDataFrame([], schema)
    known = Matrix(matrix.rows.where("label IS NOT NULL"), matrix.cells)
    classes = distinct_labels(known.rows)
    folds = clamped_fold_count(known.rows, n_folds, "label")
    if any(s.gamma == "scale" for s in settings):
        gamma = scale(known)
        settings = [replace(s, gamma=gamma) if s.gamma == "scale" else s for s in settings]
    marked = stratified_folds(known.rows.select("id", "label"), folds, "label", "id", seed)
    landmarks = Landmarks.of(known, settings[0].n_landmarks, settings[0].seed)
    table = materialize(landmarks.products(marked, known.cells))
    per = 1 if len(classes) == 2 else len(classes)
    tasks = [Task(s, f, k) for s in range(len(settings)) for f in range(folds) for k in range(per)]
    weights = newton(table, landmarks, settings, tasks, classes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros((len(settings), folds), np.int64)
        total = np.zeros(folds, np.int64)
        for batch, dots, lengths in _blocks(batches):
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            place = np.array([classes.index(x) for x in batch.column("label").to_pylist()])
            total += np.bincount(fold, minlength=folds)
            for s, setting in enumerate(settings):
                kernel = setting.of_products(dots, lengths, landmarks.lengths)
                for f in range(folds):
                    mine = fold == f
                    w = np.stack([weights[Task(s, f, k)] for k in range(per)])
                    margin = kernel[mine] @ w[:, :-1].T + w[:, -1]
                    found = (margin[:, 0] >= 0).astype(int) if per == 1 else margin.argmax(axis=1)
                    right[s, f] += int((found == place[mine]).sum())
        rows = [(s, f, int(right[s, f]), int(total[f])) for s in range(len(settings)) for f in range(folds)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
            ["setting", "fold", "hits", "n"],
        )

    counted = table.mapInArrow(judge, "setting int, fold int, hits long, n long").groupBy("setting", "fold")
    named = spark.createDataFrame(
        [(i, json.dumps(c, sort_keys=True)) for i, c in enumerate(candidates)], "setting int, params string"
    )
    return (
        counted.agg((F.sum("hits") / F.sum("n")).alias("score"))
        .join(F.broadcast(named), "setting")
        .select("params", "fold", "score")
    )
