"""Writers for the file layouts of text classification experiments.

Tables between jobs are Parquet; delimited text is for exchange with other tools.
Large outputs are partitioned by the columns readers filter on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.clusters import posting_directory
from ..operators.matrix import Matrix
from .readers import ID_COL, LABEL_COL, METRIC_COLS, PREDICTION_COLS, TEXT_COL


def _delimited(df: DataFrame, path: str, sep: str = "\t", by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("sep", sep).option("header", "true")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_text_table(docs: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """(id, label, text) under the reserved column names; ``by`` keeps more columns as folders."""
    named = docs.select(
        F.col("id").alias(ID_COL), F.col("label").alias(LABEL_COL), F.col("text").alias(TEXT_COL), *by
    )
    _delimited(named, path, by=by)


def write_folds(docs: DataFrame, path: str) -> None:
    """One folder per fold."""
    write_text_table(docs, path, ["fold"])


def write_cv(docs: DataFrame, path: str) -> None:
    """One folder per outer fold and train or test part (see ``cv_expand``)."""
    write_text_table(docs, path, ["cv", "split"])


def write_vectors(matrix: Matrix, path: str) -> None:
    """Rows and nonzero cells as Parquet."""
    matrix.rows.write.mode("overwrite").parquet(f"{path}/rows")
    matrix.cells.write.mode("overwrite").parquet(f"{path}/cells")


def read_vectors(spark: SparkSession, path: str) -> Matrix:
    """What ``write_vectors`` wrote."""
    return Matrix(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"))


def write_wide_vectors(matrix: Matrix, features: Sequence[str], path: str) -> None:
    """One column per named term in sorted order, zeros written out."""
    wide = matrix.to_wide(features)
    _delimited(wide.withColumnRenamed("id", ID_COL).withColumnRenamed("label", LABEL_COL), path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """(doc_id, y_true, y_pred), or (doc_id, y_pred) where the truth is unknown."""
    doc, true, pred = PREDICTION_COLS
    if "y_true" in preds.columns:
        table = preds.select(F.col("doc_id").alias(doc), F.col("y_true").alias(true), F.col("y_pred").alias(pred))
        _delimited(table, path)
    else:
        preds.select("doc_id", "y_pred").write.mode("overwrite").option("sep", "\t").csv(path)


def write_metrics(table: DataFrame, path: str) -> None:
    """One row per configuration under the 14 metric-file columns."""
    source = (
        "category", "vectorization", "transformation", "classifier", "acc", "balanced_acc", "err_0",
        "err_1", "f1_0", "f1_1", "f1_macro", "mcc", "nb0", "nb1",
    )
    named = table.select(*[F.col(c).alias(n) for c, n in zip(source, METRIC_COLS)])
    _delimited(named, path)


def write_supervised_lines(docs: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """``__label__`` lines for an outside classifier."""
    lines = docs.select(*by, T.supervised_line(F.col("label"), F.col("text")).alias("value"))
    writer = lines.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_class_files(docs: DataFrame, path: str) -> None:
    """One folder per split and class, each document one normalised line."""
    lines = docs.select("split", "label", T.class_file_line(F.col("text")).alias("value"))
    lines.write.mode("overwrite").partitionBy("split", "label").text(path)


def write_cluster_index(
    index: DataFrame, lines: DataFrame, documents: DataFrame, summary: DataFrame, path: str
) -> None:
    """Cluster table, posting lines and their directory, chunk count, document list and summary
    of a cluster index."""
    _delimited(index, f"{path}/index")
    _delimited(lines, f"{path}/postings")
    _delimited(posting_directory(lines), f"{path}/chunks")
    _delimited(
        index.agg(F.count(F.lit(1)).alias("n")).select(F.lit("#").alias("chunk"), F.lit(1).alias("number"), "n"),
        f"{path}/chunk_index",
    )
    _delimited(documents, f"{path}/corpus_index")
    text = F.concat_ws(
        "\n",
        *[
            F.concat(F.lit(f"{c.upper()}="), F.col(c).cast("string"))
            for c in ("nb_scanned_words", "size_voc", "nb_validated_scanned_words", "nb_files")
        ],
    )
    summary.select(text.alias("value")).write.mode("overwrite").text(f"{path}/info")


def write_comparison(ranked: DataFrame, config: Sequence[str], path: str) -> None:
    """Space-separated report lines with scores to 3 decimals."""
    def three(c: str):
        return F.format_string("%.3f", F.col(c))

    line = F.concat_ws(
        " ", "scope", *config, three("mean_score"), three("worst_score"), "worst_category",
        three("best_score"), "best_category", three("gap_to_best"), three("stability"),
        F.col("rank").cast("string"),
    )
    ranked.select("metric", "scope", line.alias("value")).write.mode("overwrite").partitionBy(
        "metric", "scope"
    ).text(path)


def write_selected(docs: DataFrame, path: str) -> None:
    """Selected decisions, one folder per outcome."""
    docs.write.mode("overwrite").partitionBy("outcome").parquet(path)
