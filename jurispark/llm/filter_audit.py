"""Audit of five text filters in every order, by contraction of a contingency tensor.

One pass over the texts gives each row the conditions it fails and a digest of its text.  From
then on rows are only counted: per part (source) there are 32 patterns of passed and failed
conditions, a tensor of 2 x 2 x 2 x 2 x 2 counts (of all rows, of good ones, of toxic ones).
Every figure of every step of every order is a contraction of that tensor in which each axis is
reduced to its passing half, its failing half, or the sum of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # in percent of the words
MAX_CAPITALS = 2  # in percent of the code points
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
PIECE = 1_000_000  # bytes of a text that are split into words at a time
PARTS = 64  # parts whose tensors are contracted together
PASS, FAIL, ALL = 0, 1, 2
HALVES = np.array([[1, 0], [0, 1], [1, 1]], np.int64)  # by PASS, FAIL, ALL

ORDERS = ["".join(p) for p in permutations(FILTERS)]
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words, and distinct words; a long text is split piece by piece."""
    text, total, seen, at = text.translate(BLANKS), 0, set(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        words = text[at : end if end >= 0 else len(text)].split()
        total += len(words)
        seen.update(words)
        at = end if end >= 0 else len(text)
    return total, len(seen)


def failed(text: str) -> int:
    """Conditions A to D that a text fails, as bits 16, 8, 4 and 2."""
    raw = text.encode()
    words, distinct = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        16 * (words < MIN_WORDS)
        + 8 * (100 * distinct < MIN_DISTINCT * words)
        + 4 * (100 * capitals > MAX_CAPITALS * len(text))
        + 2 * (len(raw) != len(raw.translate(None, SYMBOLS)))
    )


def facts(docs: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """(row_id, part, bits, digest) per row; ``digest`` is the SHA-256 of the text."""
    kind = docs.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            bits = pa.array([failed(t) for t in texts], pa.int32())
            digest = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("part"), bits, digest],
                ["row_id", "part", "bits", "digest"],
            )

    return docs.select(
        F.col(row_id).alias("row_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).mapInArrow(run, f"row_id {kind}, part string, bits int, digest binary")


def contingency(
    docs: DataFrame,
    labels: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(part, pattern, n, good, toxic): rows per part and pattern of failed conditions.

    Bits 16, 8, 4, 2, 1 of ``pattern`` stand for A to E.  Copies are counted before they are
    brought together by digest, so a large group of copies is a few rows there.
    """
    marked = materialize(facts(docs, row_id, text, source))
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int")).alias(name)
    judged = (
        labels.select(F.col(row_id).alias("row_id"), "quality", "toxic")
        .where("row_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
        .groupBy("row_id")
        .agg(flag("quality"), flag("toxic"))
    )
    none = F.lit(0)
    named = marked.where("row_id IS NOT NULL").join(judged, "row_id", "left").select(
        *marked.columns, F.coalesce("quality", none).alias("good"), F.coalesce("toxic", none).alias("toxic")
    )
    bare = marked.where("row_id IS NULL").select(*marked.columns, none.alias("good"), none.alias("toxic"))
    kinds = ["digest", "part", "bits", "good", "toxic"]
    once = named.unionAll(bare).groupBy("row_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    copies = (
        once.withColumn("named", F.col("row_id").isNotNull())
        .groupBy(*kinds, "named")
        .agg(F.min(F.struct("row_id", "n")).alias("first"), F.sum("n").alias("n"))
    )
    least = F.min(F.when(F.col("named"), F.col("first.row_id"))).over(W.partitionBy("digest"))
    original = (
        F.when(~F.col("named"), F.col("n"))
        .when(F.col("first.row_id") == F.col("least"), F.col("first.n"))
        .otherwise(F.lit(0))
    )
    split = F.explode(
        F.array(
            F.struct(F.col("bits").alias("pattern"), F.col("original").alias("n")),
            F.struct((F.col("bits") + 1).alias("pattern"), (F.col("n") - F.col("original")).alias("n")),
        )
    )
    return (
        copies.withColumn("least", least)
        .withColumn("original", original.cast("long"))
        .select("part", "good", "toxic", split.alias("x"))
        .where("x.n > 0")
        .groupBy("part", F.col("x.pattern").alias("pattern"))
        .agg(
            F.sum("x.n").alias("n"),
            F.sum(F.col("x.n") * F.col("good")).alias("good"),
            F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"),
        )
    )


def selections() -> dict[str, np.ndarray]:
    """For each figure, which half of each axis every (order, step) takes: 600 x 5."""
    place = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])  # order x axis
    step = np.arange(5)[None, :, None]
    at = place[:, None, :]
    own, before = at == step, at < step
    out = {
        "kept": np.where(before | own, PASS, ALL),
        "removed": np.where(own, FAIL, np.where(before, PASS, ALL)),
        "failing": np.where(own, FAIL, ALL) + 0 * at,
        "unique_fails": np.where(own, FAIL, PASS),
    }
    return {name: x.reshape(-1, 5) for name, x in out.items()}


def contract(tensors: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """parts x 3 x 2 x 2 x 2 x 2 x 2 counts, each axis reduced as chosen: parts x 3 x rows."""
    halves = [HALVES[choice[:, axis]] for axis in range(5)]
    return np.einsum("pmabcde,sa,sb,sc,sd,se->pms", tensors, *halves)


def figures(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """Parts x 600 of each figure, by order and step."""
    made = {name: contract(tensors, choice) for name, choice in selections().items()}
    removed = made["removed"][:, 0]
    own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    total = np.zeros((len(tensors), 5), np.int64)
    np.add.at(total.T, own, removed.T)
    return {
        "kept": made["kept"][:, 0],
        "removed": removed,
        "redundant": made["failing"][:, 0] - removed,
        "unique_fails": made["unique_fails"][:, 0],
        "good_lost": made["removed"][:, 1],
        "toxic_lost": made["removed"][:, 2],
        "shapley": total[:, own],
    }


def audit(
    docs: DataFrame,
    labels: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of FIGURES.

    A: under 200 words.  B: distinct words under half of the words.  C: capitals A-Z over 2 % of
    the code points.  D: a character of ``#$%&*|``.  E: the text of a row with a smaller id,
    whatever becomes of that row.  ``filter`` is the one of the step.

    NULL texts are empty; a NULL source is the part named by the empty string, as is an empty
    source.  A row with a NULL id is no copy of any and makes no other one a copy; it has no
    labels.  Repeated rows count as often as they occur, and are no copies of each other.  A row
    with several labels is good (toxic) if one of them says so.  An empty table has no parts, so
    no rows.  Other columns are ignored, whatever their names.
    """
    counts = contingency(docs, labels, row_id, text, source)
    cells = counts.groupBy("part").agg(
        F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("cells")  # at most 32
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = len(ORDERS) * 5
        for batch in (b.slice(i, PARTS) for b in batches for i in range(0, b.num_rows, PARTS)):
            names = batch.column("part").to_pylist()
            tensors = np.zeros((len(names), 3, 32), np.int64)
            for p, found in enumerate(batch.column("cells").to_pylist()):
                for x in found:
                    tensors[p, :, x["pattern"]] = x["n"], x["good"], x["toxic"]
            made = figures(tensors.reshape(-1, 3, 2, 2, 2, 2, 2))
            for p, name in enumerate(names):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * rows, pa.string()),
                        pa.array([order for order in ORDERS for _ in FILTERS], pa.string()),
                        pa.array(list(range(1, 6)) * len(ORDERS), pa.int32()),
                        pa.array([f for order in ORDERS for f in order], pa.string()),
                        *[pa.array(made[f][p], pa.int64()) for f in FIGURES],
                    ],
                    ["part", "filter_order", "step", "filter", *FIGURES],
                )

    kinds = "part string, filter_order string, step int, filter string, "
    return cells.mapInArrow(run, kinds + ", ".join(f"{f} long" for f in FIGURES))


# Every order counted row by row in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
j AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
  FROM labels GROUP BY doc_id),
bits AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 16 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 8 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 2 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS pattern
  FROM d LEFT JOIN j USING (doc_id)),
counts AS (
  SELECT part, pattern, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 16), ('B', 8), ('C', 4), ('D', 2), ('E', 1)) v(x, bit)),
orders AS (
  SELECT [a, b, c, d, e] AS letters
  FROM (SELECT f1.x AS a, f2.x AS b, f3.x AS c, f4.x AS d, f5.x AS e
        FROM f f1, f f2, f f3, f f4, f f5)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
steps AS (
  SELECT array_to_string(letters, '') AS filter_order, CAST(s AS INTEGER) AS step, letters[s] AS filter,
    list_sum(list_transform(letters[1:s], lambda x: CAST(2 ** (4 - (ascii(x) - 65)) AS INTEGER))) AS upto,
    CAST(2 ** (4 - (ascii(letters[s]) - 65)) AS INTEGER) AS bit
  FROM orders, range(1, 6) r(s)),
sums AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN pattern & CAST(upto AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN pattern & CAST(upto AS INTEGER) = bit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN pattern & bit <> 0 AND pattern & CAST(upto AS INTEGER) <> bit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN pattern = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN pattern & CAST(upto AS INTEGER) = bit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN pattern & CAST(upto AS INTEGER) = bit THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM sums
"""
