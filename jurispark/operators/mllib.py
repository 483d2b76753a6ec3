"""MLlib estimators behind the same fit / predict / transform calls as the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    RandomForestClassifier,
)
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .matrix import Matrix
from .terms import distinct_labels
from .vectors import FeatureSpace


def decision_tree(**settings) -> DecisionTreeClassifier:
    """Gini impurity; deep enough to stop at pure leaves on most data."""
    return DecisionTreeClassifier(**{"impurity": "gini", "maxDepth": 30, "seed": 0, **settings})


def random_forest(**settings) -> RandomForestClassifier:
    return RandomForestClassifier(**{"numTrees": 10, "maxDepth": 30, "seed": 0, **settings})


def extra_trees(**settings) -> RandomForestClassifier:
    """Trees on all rows that differ by their feature subsets only."""
    return RandomForestClassifier(
        **{
            "numTrees": 10, "maxDepth": 30, "seed": 0, "bootstrap": False,
            "featureSubsetStrategy": "sqrt", **settings,
        }
    )


def linear_svm(**settings) -> LinearSVC:
    """Linear kernel only."""
    return LinearSVC(**{"maxIter": 50, **settings})


def stored(model):
    """The model written to the scratch folder and read back.

    A fitted model may hold a summary of its training, and with it the training data; what is
    read back holds coefficients only, so the tasks that score with it stay small.
    """
    path = scratch_path(SparkSession.active())
    model.write().save(path)
    return type(model).load(path)


@dataclass(frozen=True)
class Vectors:
    """A training matrix as written vectors (id, label, features), for any number of fits."""

    table: DataFrame
    space: FeatureSpace
    classes: list

    @staticmethod
    def of(matrix: Matrix) -> Vectors:
        classes = distinct_labels(matrix.rows)
        space = FeatureSpace.of(matrix)
        return Vectors(space.vectors(matrix), space, classes)


@dataclass(frozen=True)
class MLlibClassifier:
    """Wrap an MLlib classifier; labels are encoded as their sorted position."""

    make: Callable[..., Estimator]
    settings: dict | None = None

    def fit(self, matrix: Matrix) -> MLlibModel:
        return self.fit_vectors(Vectors.of(matrix))

    def fit_vectors(self, train: Vectors) -> MLlibModel:
        names = F.array(*[F.lit(c) for c in train.classes])
        vectors = train.table.select(
            (F.array_position(names, F.col("label")) - 1).cast("double").alias("label"),
            "features",
        )
        fitted = self.make(**(self.settings or {})).fit(vectors)
        return MLlibModel(stored(fitted), train.space, train.classes)


@dataclass(frozen=True)
class MLlibModel:
    model: object
    space: FeatureSpace
    classes: list

    def predict(self, matrix: Matrix) -> DataFrame:
        return self.predict_vectors(self.space.vectors(matrix))

    def predict_vectors(self, table: DataFrame) -> DataFrame:
        """Classes of rows (id, label, features) in the feature space of the model."""
        names = F.array(*[F.lit(c) for c in self.classes])
        return self.model.transform(table).select(
            "id", "label", F.get(names, F.col("prediction").cast("int")).alias("y_pred")
        )


def _as_matrix(table: DataFrame, values, prefix: str) -> Matrix:
    """(id, label) and an array of new feature values."""
    cells = table.select("id", F.posexplode(values).alias("_pos", "value")).select(
        "id", F.concat(F.lit(prefix), (F.col("_pos") + 1).cast("string")).alias("feature"), "value"
    )
    return Matrix(table.select("id", "label"), cells.where("value <> 0"))


@dataclass(frozen=True)
class Topics:
    """Topic model by online variational Bayes."""

    n_components: int = 10
    max_iter: int = 100

    def fit(self, matrix: Matrix) -> TopicsModel:
        space = FeatureSpace.of(matrix)
        lda = LDA(
            k=self.n_components, maxIter=self.max_iter, optimizer="online", learningOffset=50.0, seed=0
        )
        return TopicsModel(stored(lda.fit(space.vectors(matrix))), space)


@dataclass(frozen=True)
class TopicsModel:
    model: object
    space: FeatureSpace

    def transform(self, matrix: Matrix) -> Matrix:
        scored = self.model.transform(self.space.vectors(matrix))
        return _as_matrix(scored, vector_to_array("topicDistribution"), "topic")

    def top_terms(self, n: int = 10) -> DataFrame:
        """(topic, rank, feature, weight): the heaviest features of each topic."""
        topics = self.model.describeTopics(n).select(
            "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "_t")
        )
        named = topics.select(
            "topic",
            (F.col("rank") + 1).alias("rank"),
            F.col("_t.termIndices").alias("fidx"),
            F.col("_t.termWeights").alias("weight"),
        )
        return named.join(self.space.index, "fidx").select("topic", "rank", "feature", "weight")
