"""Classifiers and space transformations by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lsa, mllib, trees
from .bayes import BernoulliBayes
from .discriminant import Discriminant
from .kernel_svm import KernelSVM
from .knn import Neighbours
from .matrix import Matrix
from .pls import PLS, PLSModel
from .spectral import SpectralDiscriminant

# Settings the named variants use when none are given.
DEFAULT_COMPONENTS, DEFAULT_NU = 2, 14.0
LIBRARY_COMPONENTS = 10
TRANSFORMATION_COMPONENTS = 11


def _count_features(matrix: Matrix) -> int:
    return matrix.cells.where("value <> 0").select("feature").distinct().count()


@dataclass(frozen=True)
class PLSClassifier:
    """A partial-least-squares variant with the ``predict`` of the other classifiers."""

    params: PLS

    def fit(self, matrix: Matrix) -> PLSClassifierModel:
        return PLSClassifierModel(self.params.fit(matrix), None)


@dataclass(frozen=True)
class PLSRegressionClassifier:
    """Plain PLS as a regression on the label; class 1 where the estimate exceeds its mean.

    With more components than features, one less than the number of features is used.
    ``canonical`` takes the label off by its own score, so one component is all there is.
    """

    n_components: int = LIBRARY_COMPONENTS
    canonical: bool = False

    def fit(self, matrix: Matrix) -> PLSClassifierModel:
        h = self.n_components
        if not self.canonical:
            k = _count_features(matrix)
            h = max(1, k - 1) if h > k else h
        return PLSClassifierModel(PLS("standard", 1 if self.canonical else h).fit(matrix), self)


@dataclass(frozen=True)
class PLSClassifierModel:
    model: PLSModel
    regression: PLSRegressionClassifier | None

    def predict(self, matrix: Matrix) -> DataFrame:
        scored = self.model.predict(matrix)
        index = F.col("y_pred")
        if self.regression is not None:
            # The standardised estimate has mean 0; the canonical one is t1 itself, which
            # has the sign of its coefficient times t1.
            index = (F.col("score") > 0).cast("int")
        names = F.array(*[F.lit(c) for c in self.model.classes])
        return scored.select("id", "label", F.get(names, index).alias("y_pred"))

    def transform(self, matrix: Matrix) -> Matrix:
        """The components as new features."""
        table = self.model.transform(matrix)
        entries = F.array(
            *[
                F.struct(F.lit(t).alias("feature"), F.col(t).alias("value"))
                for t in self.model.components
            ]
        )
        return Matrix(
            table.select("id", "label"), table.select("id", F.inline(entries)).where("value <> 0")
        )


def pls(variant: str, n_components: int = DEFAULT_COMPONENTS, nu: float = DEFAULT_NU, **more):
    return PLSClassifier(PLS(variant, n_components, nu, **more))


CLASSIFIERS = {
    "linearDA": lambda **s: SpectralDiscriminant(**s),
    "quadraticDA": lambda **s: Discriminant("quadratic", **s),
    "GaussianNB": lambda **s: BernoulliBayes(**s),
    "KNN": lambda **s: Neighbours(**s),
    "SVM": lambda **s: KernelSVM(**s),
    "LinearSVM": lambda **s: mllib.MLlibClassifier(mllib.linear_svm, s),
    "Tree": lambda **s: mllib.MLlibClassifier(mllib.decision_tree, s),
    "RandomForest": lambda **s: mllib.MLlibClassifier(mllib.random_forest, s),
    "ExactTree": lambda **s: trees.Trees(**s),
    "ExactForest": lambda **s: trees.forest(**s),
    "ExtraTrees": lambda **s: trees.extra_trees(**s),
    "pls_standard": lambda **s: pls("standard", **s),
    "pls_gini": lambda **s: pls("gini", **s),
    "pls_logit": lambda **s: pls("logit", **s),
    "pls_logit_gini": lambda **s: pls("logit_gini", **s),
    "pls_canonical": lambda **s: PLSRegressionClassifier(canonical=True, **s),
    "pls_regression": lambda **s: PLSRegressionClassifier(**s),
}

TRANSFORMATIONS = {
    "lsa": lambda **s: lsa.LatentSemantics(**s),
    "latentDA": lambda **s: mllib.Topics(**s),
    "linearDA": CLASSIFIERS["linearDA"],
    "quadraticDA": CLASSIFIERS["quadraticDA"],
    "pls_standard": CLASSIFIERS["pls_standard"],
    "pls_gini": CLASSIFIERS["pls_gini"],
    "pls_logit": CLASSIFIERS["pls_logit"],
    "pls_logit_gini": CLASSIFIERS["pls_logit_gini"],
    "pls_canonical": CLASSIFIERS["pls_canonical"],
    "pls_regression": CLASSIFIERS["pls_regression"],
}


def classifier(name: str, **settings):
    """A classifier by name."""
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}; known: {sorted(CLASSIFIERS)}")
    return CLASSIFIERS[name](**settings)


def transformation(name: str, matrix: Matrix | None = None, **settings):
    """A space transformation by name; lsa and latentDA size themselves by the matrix."""
    if name not in TRANSFORMATIONS:
        raise ValueError(f"unknown transformation {name!r}; known: {sorted(TRANSFORMATIONS)}")
    if name in ("lsa", "latentDA") and "n_components" not in settings and matrix is not None:
        settings["n_components"] = min(TRANSFORMATION_COMPONENTS, _count_features(matrix))
    return TRANSFORMATIONS[name](**settings)


__all__ = ["CLASSIFIERS", "TRANSFORMATIONS", "classifier", "transformation"]
