"""jurispark: supervised text analytics on large labelled corpora, on Spark DataFrames.

Texts go in as DataFrames; term statistics, vectors, folds, partial-least-squares
models, predictions and metrics come out as DataFrames.  See README.md for the map.
"""

from .session import get_session

__all__ = ["get_session"]
