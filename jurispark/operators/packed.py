"""Sorted columns in packed pieces: a block of rows sends one piece per column instead of one row per value.

A piece is a table row with the key of its column and binary arrays of equal length, sorted by
the first one.  A column with more rows than one task should sort is cut into ranges of its
values; equal values share a range, and a block holds a value of a column once or in one run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew

# One value in so many of each piece helps to choose the cuts of a long column.
SAMPLE_STEP = 64


def coded(x: np.ndarray, kind: str) -> bytes:
    """An array as bytes.  ``planes``: doubles, first bytes first; ``sorted``: so with their differences as bits.

    What neighbours share then lies together, and the compression of a shuffle finds it.
    """
    if kind == "sorted":
        x = np.diff(np.ascontiguousarray(x, dtype="f8").view("i8"), prepend=np.int64(0))
    elif kind == "planes":
        x = np.ascontiguousarray(x, dtype="f8")
    else:
        return np.ascontiguousarray(x, dtype=kind).tobytes()
    return x.view("u1").reshape(-1, 8).T.tobytes()


def decoded(data: bytes | None, kind: str) -> np.ndarray:
    """The array that ``coded`` took; empty where there is none."""
    if kind not in ("sorted", "planes"):
        return np.frombuffer(data or b"", dtype=kind)
    x = np.ascontiguousarray(np.frombuffer(data or b"", dtype="u1").reshape(8, -1).T)
    if kind == "planes":
        return x.view("f8").ravel()
    return np.cumsum(x.view("i8").ravel()).view("f8")


def arrays(row, kinds: dict) -> dict[str, np.ndarray]:
    """The binary columns of a table row as arrays."""
    return {name: decoded(getattr(row, name), kind) for name, kind in kinds.items()}


def joined(group: pd.DataFrame, kinds: dict) -> dict[str, np.ndarray]:
    """The arrays of all pieces of a group, one after the other."""
    return {
        name: np.concatenate([decoded(None, kind), *(decoded(x, kind) for x in group[name])])
        for name, kind in kinds.items()
    }


def schema_of(table: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, in a sorted array."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def in_parts(
    pieces: DataFrame, keys: Sequence[str], kinds: dict, n_rows: float, n_columns: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """(pieces with their ``part``, cuts of each column, number of parts).

    ``kinds`` names the arrays, the sorted one first.  Columns of up to ROWS_PER_SLICE rows have
    one part and no cuts.
    """
    parts = max(1, math.ceil(n_rows / skew.ROWS_PER_SLICE))
    if parts == 1:
        return pieces.withColumn("part", F.lit(0)), None, 1
    keys, order = list(keys), next(iter(kinds))
    names = [f.name for f in pieces.schema]
    key_schema = ", ".join(f"{k} int" for k in keys)

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[keys].assign(x=[decoded(x, kinds[order])[::SAMPLE_STEP].tobytes() for x in frame[order]])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.frombuffer(b"".join(group["x"])))
        at = [len(x) * p // parts for p in range(1, parts)]
        return group[keys].head(1).assign(cuts=[x[at]])

    cuts = (
        pieces.select(*keys, order).mapInPandas(sample, f"{key_schema}, x binary")
        .groupBy(*keys).applyInPandas(choose, f"{key_schema}, cuts array<double>")
    )
    small = n_columns <= skew.BROADCAST_ROWS // parts
    found = pieces.join(F.broadcast(cuts) if small else cuts, keys)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                values, given = arrays(row, kinds), row._asdict()
                ends = np.searchsorted(values[order], np.asarray(row.cuts), "right")
                ends = [0, *ends, len(values[order])]
                for p in range(parts):
                    if ends[p] < ends[p + 1]:
                        cut = {c: coded(values[c][ends[p] : ends[p + 1]], kind) for c, kind in kinds.items()}
                        out.append({**{c: given[c] for c in names}, **cut, "part": p})
            yield pd.DataFrame(out, columns=[*names, "part"])

    return found.mapInPandas(split, f"{schema_of(pieces)}, part int"), cuts, parts
