"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes.  On a bounded sample several rotations are learned (iterative quantisation: alternate
between the signs of the rotated vectors and the rotation that fits these signs best); the signs
of all rotated components are the code of a vector, an inner product shows as a small Hamming
distance.  Vectors of unequal length get one more component that makes them equally long, so the
largest inner product is the smallest angle.

Index.  Every vector is in one block; a block keeps one table per 16-bit substring of the code.
Two codes within R bits of each other agree in some substring to floor(R / substrings) bits
(pigeonhole), so the tables are probed with all values in that ball; what is found is exactly
the set of codes within R once the full distance is checked.  These are ranked by their inner
products in double precision.

R is learned: a share of the true neighbours within the sample lies within it, and neighbours
among more vectors lie nearer.  A query that finds fewer than k codes in a block widens R.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

K = 20
SAMPLE = 4096  # vectors that rotations and radius are learned from
PROBES = 256  # sampled vectors whose neighbours set the radius
ROTATIONS = 4
ITERATIONS = 30
SHARE = 0.99
BITS = 16  # per substring


@dataclass
class Codes:
    """Rotations (d+1, ROTATIONS * d'), the length that vectors are filled up to, the radius."""

    rotation: np.ndarray
    length: float
    radius: int

    def encode(self, x: np.ndarray, fill: bool = True) -> np.ndarray:
        """(n, substrings) of 16-bit code parts."""
        extra = np.zeros((len(x), 1))
        if fill:
            extra = np.sqrt(np.maximum(self.length**2 - (x**2).sum(axis=1, keepdims=True), 0))
        else:  # queries need only a direction
            x = x * (self.length / np.sqrt((x**2).sum(axis=1, keepdims=True)))
        bits = np.hstack([x, extra]) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def distances(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one).sum(axis=1, dtype=np.int32)


def learn(sample: np.ndarray, k: int = K, seed: int = 0) -> Codes:
    """Rotations by iterative quantisation from different starts, then the radius."""
    rng = np.random.default_rng(seed)
    length = float(np.sqrt((sample**2).sum(axis=1).max()))
    codes = Codes(np.zeros((0, 0)), length, 0)
    extra = np.sqrt(np.maximum(length**2 - (sample**2).sum(axis=1, keepdims=True), 0))
    x = np.hstack([sample, extra]) / length
    d = x.shape[1]
    wide = -(-(d - 1) // BITS) * BITS  # bits per rotation, a whole number of substrings
    parts = []
    for _ in range(ROTATIONS):
        start = rng.standard_normal((max(d, wide), max(d, wide)))
        r = np.linalg.qr(start)[0][:d, :wide]
        for _ in range(ITERATIONS):
            u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r), full_matrices=False)
            r = u @ vt
        parts.append(r)
    codes.rotation = np.hstack(parts)
    probes = sample[: min(PROBES, len(sample))]
    placed, asked = codes.encode(sample), codes.encode(probes, fill=False)
    near = []
    for i, q in enumerate(probes):
        score = sample @ q
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        near += distances(placed[best], asked[i]).tolist()
    codes.radius = int(np.quantile(near, SHARE)) + 1 if near else codes.rotation.shape[1]
    return codes


class Tables:
    """One table per substring: rows in the order of their part, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.columns = [np.ascontiguousarray(codes[:, s]) for s in range(codes.shape[1])]
        self.order = [np.argsort(c, kind="stable") for c in self.columns]
        self.values, self.starts = [], []
        for column, order in zip(self.columns, self.order, strict=True):
            values, starts = np.unique(column[order], return_index=True)
            self.values.append(values)
            self.starts.append(np.append(starts, len(column)))

    def within(self, one: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is at most ``radius`` bits from ``one``."""
        near = radius // len(self.order)
        hit = np.zeros(len(self.codes), bool)
        for s, (values, starts) in enumerate(zip(self.values, self.starts, strict=True)):
            if near >= BITS:
                hit[:] = True
                break
            # The ball of values, met with the values that occur in the table.
            probe = np.flatnonzero(np.bitwise_count(values ^ one[s]) <= near)
            if len(values) == len(self.codes):  # one row per value
                hit[self.order[s][probe]] = True
                continue
            begin, size = starts[probe], starts[probe + 1] - starts[probe]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit[self.order[s][np.repeat(begin, size) + inner]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(self.codes[rows], one) <= radius]


def fit(vectors: DataFrame, k: int = K, sample: int = SAMPLE) -> Codes | None:
    """Learn the codes from about ``sample`` rows (id, v), the first in a hash order of the ids."""
    rows = vectors.count()
    if not rows:
        return None
    keep = F.pmod(F.xxhash64("id", F.lit("codes")), F.lit(1_000_000))
    part = vectors.where(keep < int(np.ceil(1e6 * min(1.0, sample / rows))))
    got = part.orderBy("id").limit(2 * sample).select("v").toPandas()
    if not len(got):  # a chance of the hash on a few rows
        got = vectors.orderBy("id").limit(sample).select("v").toPandas()
    return learn(np.stack(got["v"].to_numpy()).astype(float), k)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    row_id: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
) -> DataFrame:
    """The ``k`` nearest rows found for every row that ``is_query`` (over column ``id``) holds for.

    Returns (query_id, rank, vec_id, score): rank 1 has the largest inner product, ties go to
    the smaller id; rows with the query's own id are no candidates.  With at least ``k``
    candidates every query gets ``k`` rows.

    Rows whose id or vector is NULL, whose vector is zero, empty, of another length than most,
    or holds NULL or non-finite numbers take no part.  Repeated candidates are found as often
    as they occur, and a repeated query id is asked once per row, its answers merged.  Other
    columns are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = blocks.usable(vectors, row_id, vector)
    codes = fit(rows, k, sample)
    schema = "query_id long, vec_id long, score double"
    if codes is None:
        return blocks.nearest(spark.createDataFrame([], schema), k, F.col("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, tables, ids, x = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != opened:
                    opened = row["block"]
                    ids, x = blocks.unpack(row["ids"], row["data"], row["n"], "<f8")
                    tables = Tables(codes.encode(x))
                asked, q = blocks.unpack(row["q_ids"], row["q_data"], row["q_n"], "<f8")
                out: tuple[list, list, list] = ([], [], [])
                for own, one, vec in zip(asked, codes.encode(q, fill=False), q, strict=True):
                    wanted = min(k, int((ids != own).sum()))
                    radius, all_bits = codes.radius, codes.rotation.shape[1]
                    while True:
                        near = tables.within(one, radius)
                        near = near[ids[near] != own]
                        if len(near) >= wanted or radius >= all_bits:
                            break
                        radius = min(all_bits, radius + BITS // 2)
                    score = x[near] @ vec
                    best = blocks.top(score, ids[near], k)
                    out[0].append(np.full(len(best), own))
                    out[1].append(ids[near[best]])
                    out[2].append(score[best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"]
                )

    packed = blocks.pack(rows, "<f8", blocks.ROWS)
    queries = blocks.pack(rows.where(is_query), "<f8", blocks.QUERIES)
    found = blocks.pairs(packed, queries).mapInArrow(run, schema)
    return blocks.nearest(found, k, F.col("score")).select("query_id", "rank", "vec_id", "score")
