"""Bernoulli naive Bayes on sparse matrices: a feature counts as present if it is above 0."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .matrix import Matrix
from .skew import weighted_join
from .terms import class_sizes, distinct_labels


@dataclass(frozen=True)
class BernoulliBayes:
    """``smoothing`` is added to the count of each of the two outcomes."""

    smoothing: float = 1.0

    def fit(self, matrix: Matrix) -> BernoulliBayesModel:
        classes = distinct_labels(matrix.rows)
        sizes = class_sizes(matrix.rows, "label", classes)
        labelled = matrix.cells.join(matrix.rows, "id")
        present = F.col("value") > 0
        counts = labelled.groupBy("feature").agg(
            F.count(F.lit(1)).alias("nnz"),
            *[
                F.count_if(present & (F.col("label") == F.lit(c))).alias(f"n_{i}")
                for i, c in enumerate(classes)
            ],
        )
        s = self.smoothing
        probs = {
            i: (F.col(f"n_{i}") + s) / (sizes[c] + 2.0 * s) for i, c in enumerate(classes)
        }
        table = materialize(
            counts.select(
                "feature",
                "nnz",
                *[(F.log(p) - F.log(1 - p)).alias(f"d_{i}") for i, p in probs.items()],
                *[F.log(1 - p).alias(f"o_{i}") for i, p in probs.items()],
            )
        )
        row = table.agg(
            F.count(F.lit(1)).alias("k"), *[F.sum(f"o_{i}").alias(f"o_{i}") for i in probs]
        ).first()
        start = [
            float(np.log(sizes[c] / sizes[None]) + row[f"o_{i}"]) for i, c in enumerate(classes)
        ]
        return BernoulliBayesModel(classes, start, table, row["k"])


@dataclass(frozen=True)
class BernoulliBayesModel:
    classes: list
    start: list[float]
    table: DataFrame
    n_features: int

    def predict(self, matrix: Matrix) -> DataFrame:
        """(id, label, log_0.., y_pred): joint log likelihoods and the best class."""
        many = range(len(self.classes))
        deltas = self.table.select("feature", "nnz", *[f"d_{i}" for i in many])
        sums = (
            weighted_join(
                matrix.cells.where("value > 0"), deltas, ["feature"], "nnz", ["id"], self.n_features
            )
            .groupBy("id")
            .agg(*[F.sum(f"d_{i}").alias(f"_d{i}") for i in many])
        )
        out = matrix.rows.join(sums, "id", "left").select(
            "id",
            "label",
            *[
                (F.coalesce(F.col(f"_d{i}"), F.lit(0.0)) + self.start[i]).alias(f"log_{i}")
                for i in many
            ],
        )
        top = reduce(lambda a, b: F.greatest(a, b), [F.col(f"log_{i}") for i in many]) if len(
            self.classes
        ) > 1 else F.col("log_0")
        best = F.coalesce(
            *[F.when(F.col(f"log_{i}") == top, F.lit(c)) for i, c in enumerate(self.classes)]
        )
        return out.withColumn("y_pred", best)
