"""Choosing settings by cross-validation.

Each (setting, fold) is a distributed fit; a few run side by side.  Scores form a
small table, from which the choice is made.
"""

from __future__ import annotations

import itertools
import json
import logging
import math
import random
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import ArithmeticException, IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import compare, kernel_svm, metrics, mllib, pls_grid, trees
from .folds import clamped_fold_count, stratified_folds
from .matrix import Matrix
from .pls import PLS, PLSModel
from .registry import CLASSIFIERS, classifier

log = logging.getLogger(__name__)
PARALLEL_FITS = 4
# Search ranges used when the caller gives none.
NU_RANGE = (1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9)
COMPONENTS_RANGE = (1, 2, 3, 4)
SEARCH_FOLDS = 3
# What a fit raises that its setting or its fold rules out.  Anything else (a lost executor, a full disk,
# no memory, a mistake in the code) says nothing about the setting.
UNFIT = (ValueError, ArithmeticError, ArithmeticException, IllegalArgumentException)
# So does what MLlib requires of the numbers in a task, wrapped in the failure of the job.
REQUIRED = "java.lang.IllegalArgumentException: requirement failed"


def unfit(error: Exception) -> bool:
    """Whether a fit failed by its setting or its fold."""
    return isinstance(error, UNFIT) or (isinstance(error, Py4JJavaError) and REQUIRED in str(error))


def inner_splits(
    matrix: Matrix, n_folds: int, seed: int = 0, only_first: bool = False
) -> list[tuple[int, Matrix, Matrix]]:
    """[(fold, train, test)] with the fold count clamped to the smallest class."""
    k = clamped_fold_count(matrix.rows, n_folds, "label")
    marked = materialize(stratified_folds(matrix.rows, k, "label", "id", seed))
    wanted = [0] if only_first else range(k)
    return [
        (f, matrix.split(marked, F.col("fold") != f), matrix.split(marked, F.col("fold") == f))
        for f in wanted
    ]


def score_settings(
    spark: SparkSession,
    splits: Sequence[tuple[int, Matrix, Matrix]],
    settings: Iterable[dict],
    fit_and_score: Callable[[dict, Matrix, Matrix], float],
    schema: str,
) -> DataFrame:
    """(settings..., fold, score); a setting that cannot be fitted leaves a NULL score and a log line.

    An error that is not the setting's own ends the search.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(task):
        setting, (fold, train, test) = task
        try:
            value = float(fit_and_score(setting, train, test))
        except Exception as error:  # one bad setting must not end the search
            if not unfit(error):
                raise
            log.exception("setting %s failed on fold %d", setting, fold)
            value = None
        return (*[setting[n] for n in names], fold, value)

    tasks = list(itertools.product(settings, splits))
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = list(pool.map(run, tasks))
    return spark.createDataFrame(rows, f"{schema}, fold int, score double")


def pls_scores(
    matrix: Matrix,
    params: PLS,
    nu_range: Sequence[float],
    n_components_range: Sequence[int],
    n_folds: int = SEARCH_FOLDS,
    only_first: bool = False,
    seed: int = 0,
) -> DataFrame:
    """(nu, n_comp, fold, score): macro F1 of every setting on every inner fold.

    The variants without a regression per feature are fitted side by side, all nu and folds
    in the same passes.  Elsewhere numbers of components share their first components, so each
    (nu, fold) is fitted once, with the largest number, and scored for all; only with variable
    elimination, or if that fit fails, are they fitted one by one.
    """
    valid = min(n_components_range) >= 1 and min(nu_range) > 0
    if params.variant in pls_grid.SIDE_BY_SIDE and not params.use_vip and valid:
        try:
            k = clamped_fold_count(matrix.rows, n_folds, "label")
            marked = materialize(stratified_folds(matrix.rows, k, "label", "id", seed))
            folds = [0] if only_first else range(k)
            return pls_grid.grid_scores(
                matrix, marked, params, nu_range, [int(h) for h in n_components_range], folds
            )
        except ValueError:  # a fold that cannot be fitted: the others are, one by one
            log.exception("not fitted side by side")
    splits = inner_splits(matrix, n_folds, seed, only_first)
    sizes = [int(h) for h in n_components_range]

    def one_by_one(nu, train, test):
        scores = {}
        for h in sizes:
            try:
                scores[h] = replace(params, nu=nu, n_components=h).fit(train).score(test)
            except Exception:  # one bad setting must not end the search
                log.exception("nu=%s, n_components=%s failed", nu, h)
        return scores

    def run(task):
        nu, (fold, train, test) = task
        scores = None
        if not params.use_vip and len(sizes) > 1:
            try:
                largest = replace(params, nu=nu, n_components=max(sizes)).fit(train)
                scores = largest.component_scores(test)
            except Exception:
                log.exception("nu=%s failed with %s components", nu, max(sizes))
        if scores is None:
            scores = one_by_one(nu, train, test)
        return [(nu, h, fold, scores.get(h)) for h in sizes]

    tasks = list(itertools.product([float(nu) for nu in nu_range], splits))
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = [row for found in pool.map(run, tasks) for row in found]
    return matrix.rows.sparkSession.createDataFrame(
        rows, "nu double, n_comp int, fold int, score double"
    )


def select_pls(matrix: Matrix, params: PLS, nu_range, n_components_range, **settings) -> tuple[float, int]:
    """Best (nu, n_components) of the full grid."""
    scores = pls_scores(matrix, params, nu_range, n_components_range, **settings)
    best = compare.best_params(scores, ["nu", "n_comp"]).first()
    if best is None:
        raise ValueError("no setting reached a score above 0")
    return best["nu"], best["n_comp"]


def select_pls_two_stage(
    matrix: Matrix,
    params: PLS,
    nu_range: Sequence[float] = NU_RANGE,
    n_components_range: Sequence[int] = COMPONENTS_RANGE,
    **settings,
) -> tuple[float, int]:
    """Best nu at the smallest number of components, then the best number at that nu.

    The cost is the sum of both ranges instead of their product.  Variants without
    ranks do not depend on nu: all values tie and the first one wins.
    """
    nu = float(nu_range[0])
    if len(nu_range) > 1 and params.uses_ranks:
        nu, _ = select_pls(matrix, params, nu_range, [min(n_components_range)], **settings)
    h = int(n_components_range[0])
    if len(n_components_range) > 1:
        _, h = select_pls(matrix, params, [nu], n_components_range, **settings)
    return nu, h


def fit_pls_with_search(
    matrix: Matrix, params: PLS, nu_range=NU_RANGE, n_components_range=COMPONENTS_RANGE, **settings
) -> tuple[PLSModel, float, int, float]:
    """(model, nu, n_components, score on the training rows)."""
    nu, h = select_pls_two_stage(matrix, params, nu_range, n_components_range, **settings)
    model = replace(params, nu=nu, n_components=h).fit(matrix)
    return model, nu, h, model.score(matrix)


@dataclass(frozen=True)
class Uniform:
    """A number drawn evenly from [low, high]."""

    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class Integers:
    """A whole number drawn evenly from low to high, both included."""

    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randint(self.low, self.high)


# Settings searched when a tuned classifier is asked for by name, and the one of which the
# smallest value wins among equals.
TUNED = {
    "Tree": ({"maxDepth": (2, 5, 10, 30), "minInstancesPerNode": (1, 5)}, "maxDepth"),
    "KNN": ({"k": (1, 3, 5, 9, 15), "weights": ("uniform", "distance")}, "k"),
    "LinearSVM": ({"regParam": (0.001, 0.01, 0.1, 1.0)}, "regParam"),
    "quadraticDA": ({"reg_param": tuple(i / 10 for i in range(11))}, "reg_param"),
}


# The same for classifiers whose settings are drawn: (ranges, folds).
DRAWN = {
    "SVM": (
        {
            "C": Uniform(1e-3, 100.0),
            "kernel": kernel_svm.KERNELS,
            "degree": Integers(2, 4),
            "gamma": Uniform(1e-3, 100.0),
        },
        4,
    ),
}

# Classifiers that fit all candidates on all folds side by side.
SIDE_BY_SIDE = {"SVM": kernel_svm.score_candidates, "ExactTree": trees.score_candidates}


@dataclass(frozen=True)
class Tuned:
    """A classifier by name whose settings are searched on the training rows at each fit."""

    name: str
    n_folds: int = 5

    def fit(self, matrix: Matrix):
        if self.name in DRAWN:
            ranges, folds = DRAWN[self.name]
            best = random_search(matrix, self.name, ranges, folds)
            return classifier(self.name, **best).fit(matrix)
        grid, smallest = TUNED[self.name]
        best = grid_search(matrix, self.name, grid, self.n_folds, smallest)
        return classifier(self.name, **best).fit(matrix)


def _accuracy(name: str) -> Callable[[dict, Matrix, Matrix], float]:
    def fit_and_score(setting, train, test):
        model = classifier(name, **json.loads(setting["params"])).fit(train)
        preds = model.predict(test).withColumnRenamed("label", "y_true")
        return metrics.accuracy(preds).first()["accuracy"]

    return fit_and_score


def _vector_splits(splits: Sequence[tuple[int, Matrix, Matrix]]) -> list[tuple]:
    """[(fold, train, test)] as vectors, written once for all settings; an error in place of either."""

    def run(split):
        fold, train, test = split
        try:
            vectors = mllib.Vectors.of(train)
            return fold, vectors, vectors.space.vectors(test)
        except Exception as error:  # each setting reports it
            if not unfit(error):
                raise
            return fold, error, None

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(run, splits))


def _vector_accuracy(name: str) -> Callable[[dict, mllib.Vectors, DataFrame], float]:
    def fit_and_score(setting, train, test):
        if isinstance(train, Exception):
            raise train
        model = classifier(name, **json.loads(setting["params"])).fit_vectors(train)
        preds = model.predict_vectors(test).withColumnRenamed("label", "y_true")
        return metrics.accuracy(preds).first()["accuracy"]

    return fit_and_score


def search_scores(
    matrix: Matrix, name: str, candidates: Sequence[dict], n_folds: int = 5, seed: int = 0
) -> DataFrame:
    """(params, fold, score): accuracy of each candidate, written as JSON, on each fold."""
    if name in SIDE_BY_SIDE:
        return SIDE_BY_SIDE[name](matrix, candidates, n_folds, seed)
    tasks = [{"params": json.dumps(c, sort_keys=True)} for c in candidates]
    splits, score = inner_splits(matrix, n_folds, seed), _accuracy(name)
    if name in CLASSIFIERS and isinstance(CLASSIFIERS[name](), mllib.MLlibClassifier):
        splits, score = _vector_splits(splits), _vector_accuracy(name)
    return score_settings(matrix.rows.sparkSession, splits, tasks, score, "params string")


def grid_candidates(grid: dict[str, Sequence]) -> list[dict]:
    """Every combination of the listed values."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def random_candidates(grid: dict, n_iter: int = 20, seed: int = 0) -> list[dict]:
    """``n_iter`` seeded draws from lists of values, ``Uniform`` and ``Integers`` ranges.

    From lists alone, combinations are drawn without repetition (all of them if there are
    fewer), by their numbers: the product is never listed.  With a range in the grid every draw
    is independent.
    """
    rng = random.Random(seed)
    if any(hasattr(values, "draw") for values in grid.values()):
        return [
            {k: v.draw(rng) if hasattr(v, "draw") else rng.choice(list(v)) for k, v in grid.items()}
            for _ in range(n_iter)
        ]
    values = [list(v) for v in grid.values()]
    total = math.prod(len(v) for v in values)
    if total <= n_iter:
        return grid_candidates(grid)
    return [combination(dict(zip(grid, values)), i) for i in distinct_numbers(rng, total, n_iter)]


def distinct_numbers(rng: random.Random, total: int, n: int) -> list[int]:
    """``n`` different numbers below ``total``, which may be beyond what a range can hold."""
    if total < 2**62:
        return rng.sample(range(total), n)
    found: dict[int, None] = {}
    while len(found) < n:
        found[rng.randrange(total)] = None
    return list(found)


def combination(grid: dict[str, Sequence], number: int) -> dict:
    """The combination with a number; the last parameter varies fastest."""
    out = {}
    for name in reversed(grid):
        number, i = divmod(number, len(grid[name]))
        out[name] = grid[name][i]
    return {name: out[name] for name in grid}


def choose(scores: DataFrame, smallest: str | None = None) -> dict:
    """Best candidate; among equals the one with the smallest value of one parameter.

    A fold that failed counts 0.
    """
    top = compare.top_params(scores.na.fill(0.0, ["score"]), ["params"], 1).select("params", "mean_score").collect()
    if not any(r["mean_score"] for r in top) and scores.where("score IS NOT NULL").isEmpty():
        raise ValueError("no setting could be fitted")
    found = sorted((json.loads(r["params"]) for r in top), key=lambda c: json.dumps(c, sort_keys=True))
    return min(found, key=lambda c: c[smallest]) if smallest else found[0]


def grid_search(matrix: Matrix, name: str, grid: dict, n_folds: int = 5, smallest: str | None = None) -> dict:
    """Best setting of the whole grid."""
    return choose(search_scores(matrix, name, grid_candidates(grid), n_folds), smallest)


def random_search(
    matrix: Matrix, name: str, grid: dict, n_folds: int = 3, smallest: str | None = None,
    n_iter: int = 20, seed: int = 0,
) -> dict:
    """Best setting of a random part of the grid."""
    candidates = random_candidates(grid, n_iter, seed)
    return choose(search_scores(matrix, name, candidates, n_folds, seed), smallest)
