"""Linear and quadratic discriminants.

Class means and covariances are MLlib aggregates; the driver solves systems of the
size of the feature space, which this method needs by definition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .matrix import Matrix
from .terms import distinct_labels
from .vectors import FeatureSpace


def class_moments(vectors: DataFrame) -> list[tuple]:
    """[(label, n, mean, covariance)] of a (label, features) table."""
    out = []
    for c in distinct_labels(vectors):
        part = vectors.where(F.col("label") == F.lit(c))
        row = part.agg(
            F.count(F.lit(1)).alias("n"),
            Summarizer.mean(F.col("features")).alias("mean"),
            Summarizer.std(F.col("features")).alias("sd"),
        ).first()
        sd = row["sd"].toArray()
        corr = np.nan_to_num(Correlation.corr(part, "features").first()[0].toArray())
        np.fill_diagonal(corr, 1.0)
        out.append((c, row["n"], row["mean"].toArray(), corr * np.outer(sd, sd)))
    return out


@dataclass(frozen=True)
class Discriminant:
    """``kind`` is 'linear' (one covariance) or 'quadratic' (one per class).

    ``reg_param`` in [0, 1] shrinks quadratic covariances towards the identity.
    """

    kind: str = "linear"
    reg_param: float = 0.0

    def fit(self, matrix: Matrix) -> DiscriminantModel:
        space = FeatureSpace.of(matrix)
        moments = class_moments(space.vectors(matrix))
        n = sum(m[1] for m in moments)
        size = space.size
        if self.kind == "linear":
            pooled = sum((nc - 1) * cov for _, nc, _, cov in moments) / (n - len(moments))
            inverses = [np.linalg.pinv(pooled)] * len(moments)
            logdets = [0.0] * len(moments)
        elif self.kind == "quadratic":
            covs = [
                (1 - self.reg_param) * cov + self.reg_param * np.eye(size)
                for _, _, _, cov in moments
            ]
            inverses = [np.linalg.pinv(c) for c in covs]
            logdets = [
                float(np.log(np.maximum(np.linalg.eigvalsh(c), 1e-300)).sum()) for c in covs
            ]
        else:
            raise ValueError(f"unknown kind {self.kind!r}")
        return DiscriminantModel(
            self,
            space,
            [m[0] for m in moments],
            np.array([m[2] for m in moments]),
            np.array(inverses),
            np.array(logdets),
            np.log([m[1] / n for m in moments]),
        )


@dataclass(frozen=True)
class DiscriminantModel:
    params: Discriminant
    space: FeatureSpace
    classes: list
    means: np.ndarray
    inverses: np.ndarray
    logdets: np.ndarray
    log_priors: np.ndarray

    def _scores(self):
        means, inverses = self.means, self.inverses
        logdets, priors = self.logdets, self.log_priors

        @F.pandas_udf("array<double>")
        def scores(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack(features.to_numpy())
            out = np.empty((len(x), len(means)))
            for c in range(len(means)):
                gap = x - means[c]
                out[:, c] = priors[c] - 0.5 * (logdets[c] + ((gap @ inverses[c]) * gap).sum(axis=1))
            return pd.Series(list(out))

        return scores

    def decision(self, matrix: Matrix) -> DataFrame:
        """(id, label, scores): log posterior of each class, up to a constant."""
        vectors = self.space.vectors(matrix)
        return vectors.select(
            "id", "label", self._scores()(vector_to_array("features")).alias("scores")
        )

    def predict(self, matrix: Matrix) -> DataFrame:
        best = F.array_position("scores", F.array_max("scores"))
        names = F.array(*[F.lit(c) for c in self.classes])
        return self.decision(matrix).select(
            "id", "label", F.get(names, (best - 1).cast("int")).alias("y_pred")
        )

    def transform(self, matrix: Matrix) -> Matrix:
        """Score differences to the first class as new features."""
        table = self.decision(matrix)
        entries = F.array(
            *[
                F.struct(
                    F.lit(f"d{c}").alias("feature"),
                    (F.col("scores")[c] - F.col("scores")[0]).alias("value"),
                )
                for c in range(1, len(self.classes))
            ]
        )
        return Matrix(
            table.select("id", "label"), table.select("id", F.inline(entries)).where("value <> 0")
        )
