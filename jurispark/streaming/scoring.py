"""Scoring a stream of texts or vectors with fitted models.

Vectorizing and predicting need no state across rows, so each micro-batch goes
through the same functions as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.matrix import Matrix
from ..operators.pls import PLSModel
from ..operators.vectorizer import VectorizerModel


def score_texts(vectorizer: VectorizerModel, model: PLSModel) -> Callable[[DataFrame], DataFrame]:
    """Function from a batch (id, label, text) to (id, label, score, y_pred)."""

    def run(batch: DataFrame) -> DataFrame:
        return model.predict(Matrix.from_weights(batch, vectorizer.transform(batch, "id"), "id"))

    return run


def predict_stream(
    stream: DataFrame, run: Callable[[DataFrame], DataFrame], sink: str
) -> DataStreamWriter:
    """Writer that appends the predictions of each micro-batch to a Parquet folder.

    A batch goes to a folder of its own number, so one that is repeated after a failure
    replaces its earlier output.
    """

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write)
