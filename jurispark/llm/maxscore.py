"""Exact top-k search by inner product with the MaxScore rule.

Documents are sparse or dense integer vectors; each component is a term.  Because weights may be
negative, a term's part of a score is counted from its smallest possible value: for a positive
query weight the smallest entry of the block's posting list, for a negative one the largest
(absent entries are zeros), so parts are never negative and each has an upper bound.

Per block of documents and query: the k best of the queries' scores so far is the bar.  Terms in
the order of their bounds; those whose bounds together stay below the bar are non-essential: a
document that only they speak for cannot enter.  The postings of the essential terms are
traversed; then the others are probed, term by term from the largest bound, for the documents
whose parts so far plus all remaining bounds still reach the bar.  The bar starts from the exact
scores of the documents that the first terms favour, so no document is given up on a guess.
Results of the blocks are merged by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

K = 10
SEEDS = 8  # times k documents whose exact scores set the first bar


class Postings:
    """Posting list per term of a block: documents with a nonzero entry and the entries.

    A term that most documents have is kept as a full column instead, which is the same list
    without gaps.
    """

    def __init__(self, matrix: np.ndarray):
        self.n = len(matrix)
        self.columns = np.ascontiguousarray(matrix.T.astype(np.int64))
        self.low = np.minimum(self.columns.min(axis=1), 0) if self.n else np.zeros(0, np.int64)
        self.high = np.maximum(self.columns.max(axis=1), 0) if self.n else np.zeros(0, np.int64)
        full = (self.columns != 0).mean(axis=1) > 0.5
        self.low[full] = self.columns[full].min(axis=1)
        self.high[full] = self.columns[full].max(axis=1)
        self.docs = [None if f else np.flatnonzero(c) for c, f in zip(self.columns, full, strict=True)]

    def top(self, query: np.ndarray, ids: np.ndarray, own: int, k: int, bar: int | None):
        """Places and scores of the documents that may be among the ``k`` best of this block
        and reach ``bar`` (the k-th best score known, None if there are none yet)."""
        least = np.where(query > 0, query * self.low, query * self.high)
        bound = np.where(query > 0, query * self.high, query * self.low) - least
        base = int(least.sum())
        terms = np.argsort(-bound, kind="stable")
        terms = terms[bound[terms] > 0]
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # bounds from a term on
        parts = np.zeros(self.n, np.int64)
        parts[ids == own] = np.iinfo(np.int64).min // 2
        live, at = None, 0
        for at, t in enumerate(terms):
            if bar is not None and base + rest[at] < bar:
                break  # from here on all terms are non-essential
            self._add(parts, t, query[t], least[t])
            if at == 3:
                # Exact scores of the leading documents raise the bar.
                seeds = np.argpartition(-parts, min(SEEDS * k, self.n - 1))[: SEEDS * k]
                exact = np.sort(query @ self.columns[:, seeds[ids[seeds] != own]])[::-1]
                if len(exact) >= k and (bar is None or exact[k - 1] > bar):
                    bar = int(exact[k - 1])
        else:
            at = len(terms)
        # Documents of the essential postings that can still reach the bar.
        live = np.arange(self.n) if bar is None else np.flatnonzero(base + parts + rest[at] >= bar)
        live = live[ids[live] != own]
        got = parts[live]
        for j in range(at, len(terms)):
            t = terms[j]
            got = got + (query[t] * self.columns[t, live] - least[t])
            if bar is not None:
                stay = base + got + rest[j + 1] >= bar
                if not stay.all():
                    live, got = live[stay], got[stay]
        score = base + got
        best = blocks.top(score, ids[live], k)
        return live[best], score[best]

    def _add(self, parts: np.ndarray, t: int, weight: int, least: int) -> None:
        docs = self.docs[t]
        if docs is None:
            parts += weight * self.columns[t] - least
        else:
            parts -= least  # what an absent entry, a zero, is above the smallest part
            parts[docs] += weight * self.columns[t, docs]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    row_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """The ``k`` best rows for every row that ``is_query`` (over column ``id``) holds for.

    Components are floor(scale * x).  Returns (query_id, rank, vec_id, score), score an exact
    integer inner product, ties to the smaller id; rows with the query's own id are no
    candidates.

    Rows whose id or vector is NULL, whose vector is empty, of another length than most, or
    holds NULL or non-finite numbers take no part; zero vectors do.  Repeated candidates are
    found as often as they occur; a repeated query id is asked once per row, its answers
    merged.  Other columns are ignored.  An empty table gives no rows.
    """
    rows = blocks.usable(vectors, row_id, vector, allow_zero=True).select(
        "id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, postings, ids = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != opened:
                    opened = row["block"]
                    ids, x = blocks.unpack(row["ids"], row["data"], row["n"], "<i8")
                    postings = Postings(x)
                asked, q = blocks.unpack(row["q_ids"], row["q_data"], row["q_n"], "<i8")
                out: tuple[list, list, list] = ([], [], [])
                for own, vec in zip(asked, q, strict=True):
                    at, score = postings.top(vec, ids, own, k, None)
                    out[0].append(np.full(len(at), own))
                    out[1].append(ids[at])
                    out[2].append(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"]
                )

    packed = blocks.pack(rows, "<i8", blocks.ROWS)
    queries = blocks.pack(rows.where(is_query), "<i8", blocks.QUERIES)
    found = blocks.pairs(packed, queries).mapInArrow(run, "query_id long, vec_id long, score long")
    return blocks.nearest(found, k, F.col("score")).select("query_id", "rank", "vec_id", "score")


# Brute force in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
