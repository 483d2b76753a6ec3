"""MLlib vectors from sparse matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import shuffle_bucket, shuffle_key
from ..sources.scratch import materialize
from .matrix import Matrix
from .skew import row_numbers, weighted_join


# Fixed value: the stored form of a sparse MLlib vector has type 0.
SPARSE = 0


def as_vectors(rows: DataFrame, size: int, entries: str, name: str = "features") -> DataFrame:
    """Turn sorted (fidx, value) arrays into sparse vectors, without Python in the tasks.

    The stored form of a vector is a struct; it is written as such and read as a vector.
    NULL arrays become zero vectors.
    """
    pairs = F.coalesce(F.col(entries), F.array().cast("array<struct<fidx:int,value:double>>"))
    stored = F.struct(
        F.lit(SPARSE).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(pairs, lambda e: e["fidx"].cast("int")).alias("indices"),
        F.transform(pairs, lambda e: e["value"].cast("double")).alias("values"),
    )
    table = rows.select(*[c for c in rows.columns if c != entries], stored.alias(name))
    fields = [T.StructField(f.name, VectorUDT() if f.name == name else f.dataType) for f in table.schema]
    return materialize(table, T.StructType(fields))


@dataclass(frozen=True)
class FeatureSpace:
    """The feature order of a training matrix: (feature, fidx, nnz) and its size."""

    index: DataFrame
    size: int

    @staticmethod
    def of(matrix: Matrix) -> FeatureSpace:
        """Number the features of a matrix, in a reproducible order."""
        # Written first: numbering reads the counts twice, the cells once.
        counts = materialize(
            matrix.cells.where("value <> 0")
            .groupBy("feature")
            .agg(F.count(F.lit(1)).alias("nnz"))
        )
        keyed = counts.withColumn("_k", shuffle_key(0, F.col("feature"))).withColumn("_g", F.lit(0))
        numbered = row_numbers(keyed, ["_g"], ["_k", "feature"], shuffle_bucket(F.col("_k")), "_rn")
        index = materialize(
            numbered.select("feature", (F.col("_rn") - 1).cast("int").alias("fidx"), "nnz")
        )
        return FeatureSpace(index, index.count())

    def vectors(self, matrix: Matrix) -> DataFrame:
        """(id, label, features): one vector per row; unknown features drop out."""
        placed = weighted_join(
            matrix.cells.where("value <> 0"), self.index, ["feature"], "nnz", ["id"], self.size
        )
        rows = placed.groupBy("id").agg(
            F.sort_array(
                F.collect_list(F.struct("fidx", F.col("value").cast("double").alias("value")))
            ).alias("_e")
        )
        joined = matrix.rows.join(rows, "id", "left").select("id", "label", "_e")
        return as_vectors(joined, self.size, "_e")

    def arrays(self, matrix: Matrix) -> DataFrame:
        """(id, label, features) with dense arrays."""
        return self.vectors(matrix).withColumn("features", vector_to_array("features"))
