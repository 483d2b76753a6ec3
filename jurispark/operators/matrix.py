"""Labelled matrices in long form.

A matrix is two tables: ``rows`` (id, label) names every row, ``cells`` (id,
feature, value) lists what is not zero.  A missing cell is 0, so text vectors with
millions of features cost what their texts hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .skew import weighted_join


@dataclass(frozen=True)
class Matrix:
    """``rows`` (id, label) and ``cells`` (id, feature, value)."""

    rows: DataFrame
    cells: DataFrame

    @staticmethod
    def from_arrays(df: DataFrame, row_id: str, label: Column, values: Column) -> Matrix:
        """One array per row; features are positions from 0."""
        base = df.select(F.col(row_id).alias("id"), label.alias("label"), values.alias("_values"))
        # Outer: the inner form would evaluate the array once more, as a filter.
        cells = base.select("id", F.posexplode_outer("_values").alias("feature", "value")).where(
            "value is not null"
        )
        return Matrix(base.select("id", "label"), cells)

    @staticmethod
    def from_weights(
        docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", label: str = "label"
    ) -> Matrix:
        """Document vectors (doc_id, term, weight) and the documents they belong to."""
        return Matrix(
            docs.select(F.col(doc_id).alias("id"), F.col(label).alias("label")),
            weights.select(
                F.col(doc_id).alias("id"),
                F.col("term").alias("feature"),
                F.col("weight").alias("value"),
            ),
        )

    @staticmethod
    def from_wide(
        df: DataFrame, row_id: str, label: str | None, features: Sequence[str] | None = None
    ) -> Matrix:
        """One column per feature (what matrix files hold)."""
        names = list(features or [c for c in df.columns if c not in (row_id, label)])
        entries = F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
                for c in names
            ]
        )
        label_col = F.col(f"`{label}`") if label else F.lit(None).cast("int")
        rows = df.select(F.col(f"`{row_id}`").alias("id"), label_col.alias("label"))
        cells = df.select(F.col(f"`{row_id}`").alias("id"), F.inline(entries)).where("value <> 0")
        return Matrix(rows, cells)

    def written(self) -> Matrix:
        """The same matrix, computed once and read back from scratch tables."""
        return Matrix(materialize(self.rows), materialize(self.cells))

    def split(self, marked: DataFrame, condition: Column) -> Matrix:
        """The part of the matrix whose rows (id, ...) in ``marked`` meet ``condition``."""
        rows = self.rows.join(marked.where(condition).select("id"), "id", "left_semi")
        return Matrix(rows, self.cells.join(rows.select("id"), "id", "left_semi"))

    def to_wide(self, features: Sequence) -> DataFrame:
        """(id, label, one column per feature), zeros filled.  For a small, named vocabulary."""
        ordered = sorted(features)
        wide = (
            self.cells.where(F.col("feature").isin(ordered))
            .groupBy("id")
            .pivot("feature", ordered)
            .agg(F.first("value"))
        )
        return self.rows.join(wide, "id", "left").na.fill(0.0, [str(f) for f in ordered])


def feature_stats(matrix: Matrix) -> DataFrame:
    """(feature, nnz, sy, mean, sd, vmin, vmax, cov): moments with the implied zeros counted.

    One shuffle of per-task partial moments.  ``cov`` is the covariance with the 0/1
    (or any numeric) label; ddof is 1 throughout.
    """
    y = matrix.rows.select("id", F.col("label").cast("double").alias("y"))
    totals = y.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy")
    )
    row = totals.first()
    n, sy = row["n"], row["sy"]
    return stats_of_cells(matrix.cells.where("value <> 0").join(y, "id"), n, sy)


def stats_of_cells(
    cells: DataFrame, n: float | Column, sy: float | Column, by: Sequence[str] = ("feature",)
) -> DataFrame:
    """``feature_stats`` from nonzero cells (feature, value, y) of a matrix of ``n`` rows.

    For several matrices at once, ``by`` also names the columns that tell them apart and hold
    their ``n`` and ``sy``.
    """
    agg = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nnz"),
        F.avg("value").alias("_m"),
        F.var_pop("value").alias("_v"),
        F.covar_pop("value", "y").alias("_c"),
        F.sum("y").alias("_sy"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
    )
    k, m, zeros = F.col("nnz").cast("double"), F.col("_m"), F.lit(n) - F.col("nnz")
    # Combine the nonzero part with the zero part of each feature (parallel moments).
    m2 = F.col("_v") * k + m * m * k * zeros / n
    y_zero = F.when(zeros > 0, (F.lit(sy) - F.col("_sy")) / zeros).otherwise(0.0)
    cross = F.col("_c") * k + m * (F.col("_sy") / k - y_zero) * k * zeros / n
    return agg.select(
        *by,
        "nnz",
        F.col("_sy").alias("sy"),
        (m * k / n).alias("mean"),
        F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)).alias("sd"),
        F.when(zeros > 0, F.least(F.col("_min"), F.lit(0.0))).otherwise(F.col("_min")).alias("vmin"),
        F.when(zeros > 0, F.greatest(F.col("_max"), F.lit(0.0)))
        .otherwise(F.col("_max"))
        .alias("vmax"),
        (cross / (n - 1)).alias("cov"),
    )


def constant_features(stats: DataFrame) -> DataFrame:
    """Features with one value only.  Compared by extremes: a variance is never exactly 0."""
    return stats.where(F.col("vmin") == F.col("vmax")).select("feature")


def standardize(matrix: Matrix, stats: DataFrame, n_features: int | None = None) -> DataFrame:
    """(id, feature, z) of the listed cells with the mean and deviation of ``stats``."""
    kept = stats.where("vmin <> vmax").select("feature", "mean", "sd", "nnz")
    return weighted_join(
        matrix.cells, kept, ["feature"], "nnz", ["id"], right_rows=n_features
    ).select("id", "feature", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))


def encode_labels(df: DataFrame, label: str, name: str = "label_index") -> DataFrame:
    """Add the position (from 0) of the label among the sorted distinct labels; NULL for NULL.

    The distinct labels are sorted across tasks and counted per partition, so their number is
    not bound by one task either.
    """
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    placed = materialize(
        labels.repartitionByRange(label).sortWithinPartitions(label).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    shift = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    place = F.col("_at") - F.shiftleft(part, 33) + F.col("_shift")
    numbered = placed.withColumn("_part", part).join(shift, "_part").select(label, place.cast("int").alias(name))
    return df.join(numbered, label, "left").select(*df.columns, name)
