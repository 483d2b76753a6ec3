"""Many small penalised logistic regressions at once, one per feature.

Each Newton step is one aggregate over all features: partial gradients and Hessians
per task, summed per feature.  The objective is sum of log losses plus half the
squared length of the coefficients; the intercept is free.
"""

from __future__ import annotations

import warnings

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize_with


def _newton_step(size: int):
    """Column function: one Newton step from summed gradient and Hessian."""
    upper = np.triu_indices(size)
    penalty = np.ones(size)
    penalty[0] = 0.0

    @F.pandas_udf("array<double>")
    def step(beta: pd.Series, grad: pd.Series, hess: pd.Series) -> pd.Series:
        b, g = np.stack(beta.to_numpy()), np.stack(grad.to_numpy())
        h = np.zeros((len(b), size, size))
        h[:, upper[0], upper[1]] = np.stack(hess.to_numpy())
        h[:, upper[1], upper[0]] = h[:, upper[0], upper[1]]
        h += np.diag(penalty) + np.eye(size) * 1e-12
        delta = np.linalg.solve(h, (g - penalty * b)[..., None])[..., 0]
        return pd.Series(list(b + delta))

    return step


def settled(result: tuple[DataFrame, bool]) -> DataFrame:
    """The fits of ``grouped_logistic``; warns if its steps did not settle."""
    fitted, done = result
    if not done:
        warnings.warn("logistic fits did not settle within the allowed steps", stacklevel=3)
    return fitted


def grouped_logistic(
    features: DataFrame,
    observations: Callable[[DataFrame], DataFrame],
    covariates: Sequence[Column],
    tol: float = 1e-8,
    max_iter: int = 50,
) -> tuple[DataFrame, bool]:
    """Fit y ~ 1 + covariates for every row of ``features``.

    ``observations(params)`` joins the data with the current parameters and returns
    rows with the columns of ``params``, ``cnt`` (row weight), ``sy`` (weighted label)
    and whatever ``covariates`` refer to.  Returns (feature..., beta) and whether the
    steps settled within ``tol``.
    """
    xs = [F.lit(1.0), *covariates]
    size = len(xs)
    keys = features.columns
    step = _newton_step(size)
    params = features.withColumn("beta", F.array(*[F.lit(0.0)] * size))
    for _ in range(max_iter):
        data = observations(params)
        eta = sum((F.col("beta")[i] * x for i, x in enumerate(xs)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        data = data.withColumn("_p", p)
        left = F.col("sy") - F.col("cnt") * F.col("_p")
        curve = F.col("cnt") * F.col("_p") * (1 - F.col("_p"))
        sums = data.groupBy("feature").agg(
            F.array(*[F.sum(left * x) for x in xs]).alias("_g"),
            F.array(
                *[F.sum(curve * xs[i] * xs[j]) for i in range(size) for j in range(i, size)]
            ).alias("_h"),
        )
        moved = params.join(sums, "feature").withColumn("_next", step("beta", "_g", "_h"))
        change = F.array_max(F.transform(F.arrays_zip("beta", "_next"), lambda z: F.abs(z["_next"] - z["beta"])))
        params, seen = materialize_with(
            moved.select(*keys, F.col("_next").alias("beta"), change.alias("_change")),
            F.max("_change").alias("change"),
        )
        params = params.drop("_change")
        if (seen["change"] or 0.0) < tol:
            return params, True
    return params, False
