"""Whole jobs: from raw texts to vectors, models, predictions and metric tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import compare, metrics, selection
from ..operators.folds import cv_expand, stratified_folds
from ..operators.lemmas import clean_with_lemmas
from ..operators.matrix import Matrix
from ..operators.pls import PLS, PLSModel
from ..operators.registry import classifier, transformation
from ..operators.search import COMPONENTS_RANGE, NU_RANGE, SEARCH_FOLDS, fit_pls_with_search
from ..operators.selection import balance_classes
from ..operators.terms import distinct_labels
from ..operators.vectorizer import Vectorizer, VectorizerModel
from ..sources import readers, writers
from ..sources.scratch import materialize


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return path_exists(spark, f"{path}/_SUCCESS")


def preprocess(
    spark: SparkSession, root: str, out: str, lemmas: DataFrame | None = None, **switches: bool
) -> None:
    """Labelled folders of texts to one clean text table; ``lemmas`` is (token, lemma)."""
    docs = readers.labelled_folder(spark, root)
    if lemmas is None:
        clean = docs.select("doc_id", "label", T.clean_text(F.col("text"), **switches).alias("text"))
    else:
        # Ids are only unique within a label.
        keyed = docs.withColumn("_key", F.struct("label", "doc_id"))
        done = clean_with_lemmas(keyed, lemmas, "_key", **switches)
        clean = done.select(F.col("_key.doc_id"), F.col("_key.label"), "text")
    writers.write_text_table(clean.select(F.col("doc_id").alias("id"), "label", "text"), out)


def raw_to_vectors(
    spark: SparkSession,
    root: str,
    out: str,
    lemmas: DataFrame | None = None,
    k: int = 4,
    schemes: Sequence[str] = ("tfchi2", "tfidf"),
    nmin: int = 1,
    nmax: int = 2,
    seed: int = 0,
    **switches: bool,
) -> DataFrame:
    """(scheme, cv, split, path) of the vectors made from labelled folders of texts.

    Below ``out``: ``text`` (clean texts), ``cv`` (outer folds as text tables), ``models`` and
    ``vectors`` per scheme and fold.  A run that was stopped goes on after its last finished
    part; ``settings`` is written first, and other settings on the same folder are refused.
    """
    names = lemmas is not None and str(lemmas.agg(F.bit_xor(F.xxhash64("token", "lemma"))).first()[0])
    settings = json.dumps(
        {"root": root, "lemmas": names, "k": k, "schemes": list(schemes), "nmin": nmin, "nmax": nmax,
         "seed": seed, **switches}, sort_keys=True,
    )
    if is_written(spark, f"{out}/settings"):
        earlier = spark.read.parquet(f"{out}/settings").first()[0]
        if earlier != settings:
            raise ValueError(f"{out} holds a dataset with the settings {earlier}")
    else:
        spark.createDataFrame([(settings,)], "settings string").write.mode("overwrite").parquet(f"{out}/settings")
    if not is_written(spark, f"{out}/text"):
        preprocess(spark, root, f"{out}/text", lemmas, **switches)
    # Ids are only unique within a label.
    docs = readers.text_table(spark, f"{out}/text").withColumn("id", F.concat_ws("/", "label", "id"))
    if not is_written(spark, f"{out}/cv"):
        writers.write_cv(cv_expand(stratified_folds(docs, k, "label", "id", seed), k), f"{out}/cv")
    build_dataset(docs, out, k, schemes, nmin, nmax, seed, resume=True)
    parts = [(s, cv, split, f"{out}/vectors/scheme={s}/cv={cv}/split={split}")
             for s in schemes for cv in range(k) for split in ("train", "test")]
    return spark.createDataFrame(parts, "scheme string, cv int, split string, path string")


def select_decisions(spark: SparkSession, annotation_file: str, root: str, object_value, norm_value) -> DataFrame:
    """(decision, outcome, found): an annotation file and the folder of decisions, brought together.

    Decisions with a single claim about ``object_value`` under ``norm_value``; ``found`` is 1 if
    the folder holds a file of that name.
    """
    claims = selection.matching_claims(
        readers.annotations(spark, annotation_file), "object", "norm", object_value, norm_value
    ).withColumn("decision", T.decision_key(F.col("court"), F.col("city"), F.col("number")))
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    present = names.select(F.element_at(F.split("path", "/"), -1).alias("decision"))
    return selection.select_decisions(claims, present, "decision", F.col("outcome"))


def outer_experiment(
    folds: Sequence[tuple[int, Matrix, Matrix]],
    params: PLS,
    nu_range: Sequence[float] = NU_RANGE,
    n_components_range: Sequence[int] = COMPONENTS_RANGE,
    n_folds: int = SEARCH_FOLDS,
    models: str | None = None,
) -> DataFrame:
    """(fold, part, nu, n_components, f1_macro, accuracy): per outer fold, search on the training
    part, fit or reuse the model saved below ``models``, apply it to both parts.
    """
    spark = folds[0][1].rows.sparkSession
    rows = []
    for fold, train, test in folds:
        path = models and f"{models}/fold={fold}"
        if path and path_exists(spark, f"{path}/params"):
            model = PLSModel.load(spark, path)
        else:
            model = fit_pls_with_search(
                train, params, nu_range, n_components_range, n_folds=n_folds
            )[0]
            if path:
                model.save(path)
        classes = distinct_labels(train.rows)
        for part, matrix in (("train", train), ("test", test)):
            preds = materialize(encoded(model.predict(matrix), classes))
            f1 = metrics.macro_scores(preds).first()["f1_macro"]
            right = metrics.accuracy(preds).first()["accuracy"]
            rows.append((fold, part, float(model.params.nu), model.params.n_components, f1, right))
    return spark.createDataFrame(
        rows, "fold int, part string, nu double, n_components int, f1_macro double, accuracy double"
    )


def vectorize(
    docs: DataFrame,
    model_path: str | None = None,
    scheme: str = "tfidf",
    nmin: int = 1,
    nmax: int = 1,
    doc_id: str = "id",
    **settings,
) -> tuple[VectorizerModel, DataFrame]:
    """Fit a vectorizer on ``docs``, or reuse the one saved at ``model_path``; weigh ``docs``."""
    spark = docs.sparkSession
    if model_path and path_exists(spark, f"{model_path}/params"):
        model = VectorizerModel.load(spark, model_path)
    else:
        model = Vectorizer(scheme, nmin, nmax, **settings).fit(docs)
        if model_path:
            model.save(model_path)
    return model, model.transform(docs, doc_id)


def build_dataset(
    docs: DataFrame,
    out: str,
    k: int = 4,
    schemes: Sequence[str] = ("tfidf", "tfchi2"),
    nmin: int = 1,
    nmax: int = 2,
    seed: int = 0,
    resume: bool = False,
) -> None:
    """Outer folds of (id, label, text) and vectors per scheme, fold and part.

    Weights are learned on the training rows of each fold only.  With ``resume``, models and
    vectors that are there in full stay.
    """
    spark = docs.sparkSession
    folded = materialize(cv_expand(stratified_folds(docs, k, "label", "id", seed), k))
    for scheme in schemes:
        for cv in range(k):
            part = folded.where(F.col("cv") == cv)
            train = part.where("split = 'train'")
            saved = f"{out}/models/scheme={scheme}/cv={cv}"
            target = f"{out}/vectors/scheme={scheme}/cv={cv}"
            # Cells are written last.
            todo = [
                split for split in ("train", "test")
                if not (resume and is_written(spark, f"{target}/split={split}/cells"))
            ]
            if not todo:
                continue
            if resume and is_written(spark, f"{saved}/params"):
                model = VectorizerModel.load(spark, saved)
            else:
                model = Vectorizer(scheme, nmin, nmax).fit(train)
                model.save(saved)
            for split in todo:
                rows = part.where(F.col("split") == split)
                matrix = Matrix.from_weights(rows, model.transform(rows, "id"), "id")
                writers.write_vectors(matrix, f"{target}/split={split}")


def train_on_vectors(
    matrix: Matrix,
    model_path: str | None = None,
    variant: str = "standard",
    nu_range: Sequence[float] = NU_RANGE,
    n_components_range: Sequence[int] = COMPONENTS_RANGE,
    n_folds: int = SEARCH_FOLDS,
    all_folds: bool = False,
) -> tuple[PLSModel, float, int]:
    """Search nu and the number of components, fit, save."""
    model, nu, h, _ = fit_pls_with_search(
        matrix, PLS(variant), nu_range, n_components_range, n_folds=n_folds, only_first=not all_folds
    )
    if model_path:
        model.save(model_path)
    return model, nu, h


def train_on_texts(
    docs: DataFrame, scheme: str = "tfidf", nmax: int = 1, **settings
) -> tuple[VectorizerModel, PLSModel]:
    """Vectorize (id, label, text), then train on the vectors."""
    vectorizer, weights = vectorize(docs, scheme=scheme, nmax=nmax)
    matrix = Matrix.from_weights(docs, weights, "id")
    return vectorizer, train_on_vectors(matrix.written(), **settings)[0]


def apply_on_vectors(matrix: Matrix, model: PLSModel, out: str | None = None) -> DataFrame:
    """Predictions (doc_id, y_true, y_pred) of a trained model."""
    preds = model.predictions(matrix).withColumnRenamed("id", "doc_id")
    if out:
        writers.write_predictions(preds, out)
    return preds


def apply_on_texts(
    docs: DataFrame, vectorizer: VectorizerModel, model: PLSModel, out: str | None = None
) -> DataFrame:
    """Vectorize new texts with a fitted vectorizer, then predict."""
    matrix = Matrix.from_weights(docs, vectorizer.transform(docs, "id"), "id")
    return apply_on_vectors(matrix, model, out)


def f1_of_file(spark: SparkSession, path: str) -> float:
    """Macro F1 of a prediction file."""
    return metrics.macro_scores(readers.predictions(spark, path)).first()["f1_macro"]


def accuracy_of_file(spark: SparkSession, path: str) -> float:
    """Accuracy of a prediction file."""
    return metrics.accuracy(readers.predictions(spark, path)).first()["accuracy"]


def outer_folds(matrix: Matrix, k: int, seed: int = 0) -> list[tuple[int, Matrix, Matrix]]:
    """[(fold, train, test)] of a stratified k-fold cross-validation."""
    marked = materialize(stratified_folds(matrix.rows, k, "label", "id", seed))
    return [
        (f, matrix.split(marked, F.col("fold") != f), matrix.split(marked, F.col("fold") == f))
        for f in range(k)
    ]


def balanced(matrix: Matrix, seed: int = 0) -> Matrix:
    """The matrix with as many rows per class as the smallest class has."""
    rows = materialize(balance_classes(matrix.rows, "label", "id", seed))
    return Matrix(rows, matrix.cells.join(rows.select("id"), "id", "left_semi"))


def encoded(preds: DataFrame, classes: Sequence, label: str = "label") -> DataFrame:
    """(id, label, y_pred) with classes to codes (y_true, y_pred): positions in ``classes``.

    ``classes`` are those of the training rows, sorted, so a test part that lacks a class gets
    the same codes as any other.  A class that training has not seen is -1.
    """
    ordered = F.array(*[F.lit(str(c)) for c in sorted(classes)])

    def code(c: str):
        return (F.array_position(ordered, F.col(c).cast("string")) - 1).cast("int")

    return preds.select("id", code(label).alias("y_true"), code("y_pred").alias("y_pred"))


def predict_config(
    train: Matrix, test: Matrix, clf: str, space: str | None = None, balance: bool = False, **settings
) -> DataFrame:
    """(id, y_true, y_pred) of one classifier on one split, after an optional transformation."""
    if balance:
        train = balanced(train)
    if space:
        fitted = transformation(space, train).fit(train)
        train, test = fitted.transform(train), fitted.transform(test)
    classes = distinct_labels(train.rows)
    return encoded(classifier(clf, **settings).fit(train).predict(test), classes)


MANIFEST = "path string, n long, kind string"


def write_part(preds: DataFrame, where: str) -> DataFrame:
    """Write predictions to a new folder below ``where``, then a manifest that names it.

    The manifest comes last and holds the number of rows, so what a broken run leaves behind
    (part files without a manifest, or a manifest that was not committed) does not count.
    """
    spark = preds.sparkSession
    path = f"{where}/rows-{uuid.uuid4().hex}"
    preds.write.parquet(path)
    table = spark.read.schema(preds.schema).parquet(path)
    entry = spark.createDataFrame([(path, table.count(), preds.schema.json())], MANIFEST)
    entry.coalesce(1).write.mode("overwrite").parquet(f"{where}/manifest")
    return table


def finished_part(spark: SparkSession, where: str) -> DataFrame | None:
    """The predictions that the manifest below ``where`` names, if they are whole."""
    if not path_exists(spark, f"{where}/manifest"):
        return None
    entry = spark.read.schema(MANIFEST).parquet(f"{where}/manifest").first()
    if entry is None or not path_exists(spark, entry["path"]):
        return None
    kind = StructType.fromJson(json.loads(entry["kind"]))
    table = spark.read.schema(kind).parquet(entry["path"])
    return table if table.count() == entry["n"] else None


def evaluate_grid(
    vectors: dict[str, list[tuple[int, Matrix, Matrix]]],
    category: str,
    classifiers: Sequence[str],
    spaces: Sequence[str | None] = (None,),
    cache: str | None = None,
    balance: bool = False,
) -> DataFrame:
    """Metric table of every (vectorization, transformation, classifier) over its folds.

    ``vectors`` maps a vectorization name to its (fold, train, test) list.  Predictions
    are written once per configuration and fold below ``cache`` and reused if they were
    finished (see ``finished_part``); the metrics are one aggregate over all of them.
    """
    parts = []
    for vectorization, folds in vectors.items():
        for space in spaces:
            for clf in classifiers:
                for fold, train, test in folds:
                    spark = train.rows.sparkSession
                    where = cache and (
                        f"{cache}/category={category}/vectorization={vectorization}"
                        f"/space={space}/classifier={clf}/fold={fold}"
                    )
                    preds = finished_part(spark, where) if where else None
                    if preds is None:
                        preds = predict_config(train, test, clf, space, balance)
                        preds = write_part(preds, where) if where else materialize(preds)
                    parts.append(
                        preds.select(
                            F.lit(category).alias("category"),
                            F.lit(vectorization).alias("vectorization"),
                            F.lit(str(space)).alias("transformation"),
                            F.lit(clf).alias("classifier"),
                            F.lit(fold).alias("fold"),
                            "y_true",
                            "y_pred",
                        )
                    )
    preds = reduce(DataFrame.unionByName, parts)
    return metrics.fold_means(preds, ["category", "vectorization", "transformation", "classifier"])


def crossval(
    folds: Sequence[tuple[int, Matrix, Matrix]],
    classifiers: Sequence[str],
    space: str | None = None,
) -> DataFrame:
    """(transformation, classifier, accuracy, err_0, err_1, n_0, n_1), best accuracy first."""
    parts = [
        materialize(predict_config(train, test, clf, space)).select(
            F.lit(str(space)).alias("transformation"),
            F.lit(clf).alias("classifier"),
            F.lit(fold).alias("fold"),
            "y_true",
            "y_pred",
        )
        for clf in classifiers
        for fold, train, test in folds
    ]
    preds = reduce(DataFrame.unionByName, parts)
    table = metrics.fold_errors(preds, ["transformation", "classifier"], len(folds))
    return table.orderBy(F.col("accuracy").desc(), "classifier")


def compare_all(table: DataFrame, zone: str = "zone") -> DataFrame:
    """Best configurations per metric, over all categories and for each of them.

    ``table`` is a metric table (see ``evaluate_grid``) with a zone column.
    """
    config = [zone, "vectorization", "classifier"]
    scores = compare.unpivot_metrics(
        table.select(*config, "category", "acc", "f1_macro", "balanced_acc"),
        ["acc", "f1_macro", "balanced_acc"],
    )
    summary = compare.config_summary(scores, config)
    return compare.rank_configs(summary, config, "classifier", compare.PLS_CLASSIFIERS)


def run_all_classifiers(train: Matrix, test: Matrix, names: Sequence[str] = ("Tree",)) -> DataFrame:
    """Metric vector of each named classifier on one split."""
    parts = [
        materialize(predict_config(train, test, n)).withColumn("classifier", F.lit(n)) for n in names
    ]
    return metrics.metric_vector(reduce(DataFrame.unionByName, parts), ["classifier"])


