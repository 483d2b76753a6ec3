"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sizes are counted once and written; everything after that works on (id, source, size).
Targets come from rounds of "share what is left by weight, clamp what is above its cap":
each round is one aggregate over the table of sources, of which the driver sees two sums.
Which rows get the extra, fractional repetition is decided by one threshold per source on a
seeded order of its rows.  The threshold is found by refining a prefix of the order key, so
a source with a third of all rows is never gathered or sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .common import word_count

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 0
# The order key is 32 hex digits.  Each refinement looks at this many more of them: 4,096
# sums per source, and after three of them a bucket holds one in 7e10 rows.
DIGITS = 3
REFINEMENTS = 3


def order_key(row_id: Column, text: Column, seed: int) -> Column:
    """Seeded pseudo-random order of the rows, the same in every run and engine.

    Rows without an id are told apart by their texts.
    """
    bare = F.concat(F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), bare)).cast("binary"))


def numbered(sources: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0): position of each source by code point, NULL last.

    ``sources`` has one row per source.  Rows are range-partitioned and counted per
    partition, so the number of sources is not bound by one task.
    """
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(
        F.col("source").asc_nulls_last()
    )
    placed = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    shift = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.col("_at") - F.shiftleft(part, 33)
    return (
        placed.withColumn("_part", part)
        .join(shift, "_part")
        .withColumn("rank", inside + F.col("_shift"))
        .drop("_at", "_part", "_shift")
    )


def fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): shares of the total by weight, at most
    ``max_epochs`` times the size; what a clamped source gives up goes to the others by weight.

    The level (words per unit of weight) never falls from round to round, so clamped sources
    stay clamped and the rounds end when none is added.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, clamped_before = 0.0, -1
    while True:
        clamped = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        if row["n"] == clamped_before or not row["weight"]:
            break
        clamped_before = row["n"]
        level = (total - row["taken"]) / row["weight"]
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(cap <= share, cap.cast("double")).otherwise(share))


def fraction_cut(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source with an extra part: (source, cut), the last row in seeded order that
    gets one repetition more.

    A row belongs to the extra part if the middle of its words lies within ``rest`` words of
    the start of its source, rows taken in the order of (key, size).  So the words of the
    extra part are within half a row of ``rest``.
    """
    state = sources.select("source", "rest", F.lit("").alias("prefix"), F.lit(0).alias("before"))
    width = 0
    for _ in range(REFINEMENTS):
        width += DIGITS
        inside = sized.alias("d").join(
            state.alias("s"),
            F.expr("d.source <=> s.source AND startswith(d.key, s.prefix)"),
        )
        bucket = F.substring("d.key", 1, width)
        sums = inside.groupBy(F.col("d.source").alias("source"), bucket.alias("prefix")).agg(
            F.sum("d.size").alias("size"),
            F.first("s.rest").alias("rest"),
            F.first("s.before").alias("before"),
        )
        w = W.partitionBy("source").orderBy("prefix")  # at most 16**DIGITS rows per source
        reached = F.col("before") + F.sum("size").over(w)
        # The bucket in which the rest is reached, or the last one before it.
        start = reached - F.col("size")
        straddling = (
            sums.withColumn("start", start)
            .where((F.col("start") < F.col("rest")))
            .withColumn("last", F.row_number().over(W.partitionBy("source").orderBy(F.desc("prefix"))))
            .where("last = 1")
        )
        state = materialize(
            straddling.select("source", "rest", "prefix", F.col("start").alias("before"))
        )
    inside = sized.alias("d").join(
        state.alias("s"), F.expr("d.source <=> s.source AND startswith(d.key, s.prefix)")
    )
    w = W.partitionBy("d.source").orderBy("d.key", "d.size").rowsBetween(W.unboundedPreceding, -1)
    middle = 2 * (F.col("s.before") + F.coalesce(F.sum("d.size").over(w), F.lit(0))) + F.col("d.size")
    picked = inside.select(
        F.col("d.source").alias("source"),
        F.col("s.prefix").alias("prefix"),
        F.struct(F.col("d.key").alias("key"), F.col("d.size").alias("size")).alias("cut"),
        (middle <= 2 * F.col("s.rest")).alias("extra"),
    )
    # If no row of the bucket qualifies, the cut lies before the bucket: its bare prefix
    # sorts before every key in it and after every key of the earlier ones.
    return picked.groupBy("source").agg(
        F.coalesce(
            F.max(F.when(F.col("extra"), F.col("cut"))),
            F.struct(F.first("prefix").alias("key"), F.lit(-1).cast("long").alias("size")),
        ).alias("cut")
    )


def sized_rows(docs: DataFrame, row_id: str, text: str, source: str, seed: int, *keep: str) -> DataFrame:
    """(row_id, source, size, key) of each row, and the columns ``keep``."""
    return docs.select(
        F.col(row_id).alias("row_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        order_key(F.col(row_id), F.col(text), seed).alias("key"),
        *[F.col(c).alias(f"c_{c}") for c in keep],
    )


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and the cut of the extra one."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    choice = F.array(*[F.lit(w) for w in weights])
    ranked = numbered(sums).withColumn(
        "weight", choice[(F.col("rank") % len(weights)).cast("int")]
    )
    filled = fill(materialize(ranked), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    sources = materialize(
        filled.withColumn("whole", F.coalesce(whole, F.lit(0))).withColumn(
            "rest", F.col("target") - F.col("whole") * F.col("source_size")
        )
    )
    cuts = fraction_cut(sized, sources.where("rest > 0"))
    return materialize(
        sources.alias("s")
        .join(cuts.alias("c"), F.expr("s.source <=> c.source"), "left")
        .select("s.source", "source_size", "target", "whole", "cut")
    )


def with_repeats(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Join rows with the plan of their source and add ``repeats``."""
    place = F.struct(F.col("d.key").alias("key"), F.col("d.size").alias("size"))
    extra = F.coalesce(place <= F.col("p.cut"), F.lit(False))
    return (
        sized.alias("d")
        .join(sources.alias("p"), F.expr("d.source <=> p.source"))
        .withColumn("repeats", F.col("p.whole") + extra.cast("int"))
    )


def mix(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Per row: (row_id, size, source, source_size, target, taken, repeats).

    ``size`` counts words.  Sources, ordered by code point with NULL last, weigh ``weights``,
    repeating.  ``taken`` is ``size * repeats``; a row is repeated floor(target / source_size)
    times, and once more if it belongs to the fractional part (see ``fraction_cut``), so never
    more than ``max_epochs`` times.

    NULL or empty texts have size 0 and take nothing; a source without words has target 0; a
    NULL source is a source of its own.  Rows with a NULL id are told apart by their texts.  Repeated
    rows count as often as they occur and, being tied in the order, share their decision.  Columns
    besides the three named ones are ignored, whatever their names.
    """
    sized = materialize(sized_rows(docs, row_id, text, source, seed))
    return with_repeats(sized, plan(sized, weights, max_epochs)).select(
        F.col("d.row_id").alias(row_id),
        F.col("d.size").alias("size"),
        F.col("d.source").alias("source"),
        "source_size",
        "target",
        (F.col("d.size") * F.col("repeats")).alias("taken"),
        "repeats",
    )


def repeated(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as ``mix`` repeats it.

    Rows without words take no part.  Texts are not shuffled, only joined with the sources.
    """
    sized = materialize(sized_rows(docs, row_id, text, source, seed))
    sources = plan(sized, weights, max_epochs)
    rows = sized_rows(docs, row_id, text, source, seed, *docs.columns).where("size > 0")
    turns = F.sequence(F.lit(1), F.col("repeats").cast("int"))
    return (
        with_repeats(rows, sources)
        .where("repeats > 0")
        .withColumn("_turn", F.explode(turns))
        .select(*[F.col(f"c_{c}").alias(c) for c in docs.columns])
    )


# The same rows in DuckDB: targets by sorting the sources by cap per weight, the cut by a plain
# running sum.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), ':' || md5(coalesce(text, '')))) AS key
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sums),
levels AS (
  SELECT *,
    (CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY 3 * source_size / weight, source
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT max(level) AS level FROM levels),
targets AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size <= weight * final.level THEN CAST(3 * source_size AS DOUBLE)
         ELSE weight * final.level END AS target
  FROM weighed, final),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END)
       AS BIGINT) AS taken
FROM placed
"""
