"""Readers for the file layouts of text classification experiments.

Schemas are explicit, so reading never needs an inference pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import Matrix
from ..operators.skew import row_numbers

# Reserved column names of text and vector files.
ID_COL, LABEL_COL, TEXT_COL = "@id", "@label", "@text"
# Columns of prediction files and of metric files.
PREDICTION_COLS = ("docId", "y_true", "y_pred")
METRIC_COLS = (
    "categoryDmd", "vectorization", "space-transf", "classifier", "acc", "balanced-acc", "err-0",
    "err-1", "f1-0", "f1-1", "f1-macro-avg", "mcc", "nb0", "nb1",
)
# Fixed value: path of one document of a cross-validation corpus.
CV_PATH = (
    r"cv-([^/]+)/([^_/]+)_lemma_(\d+)_folds_cv/(\d+)/(train|test)/[^/]+-([^/-]+)/([^/.]+)\.txt$"
)


TOKEN = r"[^\s\p{Z}\x0B\x1C-\x1F\x85]+"


def first_token(line: str) -> Column:
    """First token of a line, between white space of any kind."""
    return F.regexp_extract(F.col(line), TOKEN, 0)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text): every file below ``root`` as one row."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(root, wholetext=True)
        .select(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("path"),
                F.col("value").alias("text"))
    )


def folder_fields(path: Column) -> dict[str, Column]:
    """Document id and label of a path: the file up to its first dot, and its folder."""
    parts = F.split(path, "/")
    return {
        "doc_id": F.split(F.element_at(parts, -1), r"\.")[0],
        "label": F.element_at(parts, -2),
    }


def cv_fields(path: Column) -> dict[str, Column]:
    """What the path of a document in a cross-validation corpus says about it."""
    names = ("zone", "category", "n_folds", "fold", "split", "label", "doc_id")
    fields = {n: F.regexp_extract(path, CV_PATH, i + 1) for i, n in enumerate(names)}
    return {n: c.cast("int") if n in ("n_folds", "fold") else c for n, c in fields.items()}


def labelled_folder(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, label, text): the folder names the label, the file up to its first dot the id."""
    fields = folder_fields(F.col("path"))
    return _files(spark, root).select(*[c.alias(n) for n, c in fields.items()], "text")


def cv_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(zone, category, n_folds, fold, split, label, doc_id, text) from the path of each file."""
    found = _files(spark, root).where(F.col("path").rlike(CV_PATH))
    fields = cv_fields(F.col("path"))
    return found.select(*[c.alias(n) for n, c in fields.items()], "text")


def text_table(
    spark: SparkSession,
    path: str,
    id_col: str = ID_COL,
    label_col: str = LABEL_COL,
    text_col: str = TEXT_COL,
    sep: str = "\t",
) -> DataFrame:
    """(id, label, text) of a delimited file with a header; columns are found by name."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return raw.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{text_col}`").alias("text"),
    )


def annotations(
    spark: SparkSession,
    path: str,
    object_col: int = 3,
    norm_col: int = 5,
    outcome_col: int = -4,
    sep: str = "\t",
) -> DataFrame:
    """(court, city, number, object, norm, outcome) of a file read by position, no header."""
    raw = spark.read.csv(path, sep=sep, header=False, inferSchema=False)
    names = ("court", "city", "number", "object", "norm", "outcome")
    places = (0, 1, 2, object_col, norm_col, outcome_col)
    return raw.select(*[F.col(raw.columns[p]).alias(n) for n, p in zip(names, places)])


def wide_matrix(
    spark: SparkSession,
    path: str,
    label_col: str | None = LABEL_COL,
    index_col: str = ID_COL,
    sep: str = "\t",
) -> Matrix:
    """A vector file (one column per term) as rows and nonzero cells."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return Matrix.from_wide(raw, index_col, label_col)


def predictions(
    spark: SparkSession, path: str, sep: str = "\t", names: Sequence[str] | None = PREDICTION_COLS
) -> DataFrame:
    """(doc_id, y_true, y_pred); with ``names=None`` the file has no header and two columns.

    A file with a header that lacks the named columns is read by its first two columns.
    """
    if names is None:
        return spark.read.csv(path, sep=sep, schema="y_true int, y_pred int")
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    doc, true, pred = names
    if not set(names) <= set(raw.columns):
        true, pred = raw.columns[:2]
        return raw.select(*[
            F.col(f"`{c}`").cast("int").alias(n) for c, n in ((true, "y_true"), (pred, "y_pred"))
        ])
    return raw.select(
        F.col(doc).alias("doc_id"),
        F.col(true).cast("int").alias("y_true"),
        F.col(pred).cast("int").alias("y_pred"),
    )


def label_column(spark: SparkSession, path: str, position: int = 1, sep: str = "\t") -> DataFrame:
    """One column of a file without header, as ``y``."""
    raw = spark.read.csv(path, sep=sep, header=False, inferSchema=False)
    return raw.select(F.col(raw.columns[position]).cast("int").alias("y"))


def metric_table(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """(category, vectorization, transformation, classifier, score) of one named metric."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return raw.select(
        F.col("categoryDmd").alias("category"),
        "vectorization",
        F.col("`space-transf`").alias("transformation"),
        "classifier",
        F.col(f"`{metric}`").cast("double").alias("score"),
    )


def cluster_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, cluster) of an unquoted tab file with one header line; the last entry wins."""
    from ..operators.clusters import clean_dictionary

    raw = (
        spark.read.option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path, sep="\t", header=True, schema="word string, cluster string", enforceSchema=True)
        .withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                    F.monotonically_increasing_id()))
    )
    return clean_dictionary(raw, "word", "cluster", "_at")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): one trimmed name per non-blank line."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): non-blank lines of one file, numbered from 0.

    Output files of outside tools carry no row id; the line number is the only one.
    Lines are numbered inside each split of the file and shifted by the line counts
    of the earlier splits, so a large file is read in parallel.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    kept = lines.where(F.col("line").rlike(TOKEN))
    numbered = row_numbers(kept, ["_file"], ["_start", "_at"], F.col("_start"), "_rn")
    return numbered.select((F.col("_rn") - 1).alias("line_no"), "line")


def supervised_predictions(spark: SparkSession, truth: str, output: str) -> DataFrame:
    """(line_no, y_true, y_pred): first tokens of the truth file and of the output file."""
    t = numbered_lines(spark, truth).select("line_no", first_token("line").alias("y_true"))
    p = numbered_lines(spark, output).select("line_no", first_token("line").alias("y_pred"))
    return t.join(p, "line_no")


def class_file_predictions(
    spark: SparkSession, first_class: str, second_class: str, output: str
) -> DataFrame:
    """(line_no, y_true, y_pred) when the truth is given by two class files.

    The lines of the first file are class 1, those of the second class -1; the
    output starts with a header line.
    """
    n_first = numbered_lines(spark, first_class).agg(F.count(F.lit(1))).scalar()
    n_all = n_first + numbered_lines(spark, second_class).agg(F.count(F.lit(1))).scalar()
    return (
        numbered_lines(spark, output)
        .where("line_no > 0")
        .select((F.col("line_no") - 1).alias("line_no"), first_token("line").alias("y_pred"))
        .where(F.col("line_no") < n_all)
        .withColumn("y_true", F.when(F.col("line_no") < n_first, "1").otherwise("-1"))
        .select("line_no", "y_true", "y_pred")
    )
