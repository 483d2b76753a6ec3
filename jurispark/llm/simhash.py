"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is cut into segments; the numbers of set bits of its segments are a point
on a grid.  The Manhattan distance of two points never exceeds the Hamming distance of the
fingerprints, so fingerprints within 2 bits have points within 2 steps, and then there is a grid
point at most one step from both.

Two flipped bits leave one of three blocks of segments untouched.  So each distinct fingerprint
is put, per block, into the cells of (the bits of that block, a grid point of the other segments
at most one step from its own): as many cells for every fingerprint.  Fingerprints that share a
cell are candidates; a cell is narrow enough to hold few that meet by chance, however many rows
there are.

Candidates are verified exactly and without pairing a cell with itself: a candidate is written
under each bit string at most one flip away.  Two fingerprints are within 2 bits if and only if
they meet under such a string, and at most 65 distinct ones can.  Each is linked to the smallest
of them, so a group of any size gives links in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .components import components

SHINGLE = 3
SEED = 42
SEGMENTS = 16
BLOCKS = 3  # one more than the bits that may differ
MAX_DIFFERENT_BITS = 2
CHUNK = 200_000  # shingles whose bits are counted at a time


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the hashes of the word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes: A-Z, and the six blanks
    if not words:
        return 0
    parts = [b" ".join(words)]
    if len(words) > size:
        flat, at = parts[0], [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        parts = [flat[i : j - 1] for i, j in zip(at, at[size:], strict=False)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, len(parts), CHUNK):
        hashes = np.array([digest(p, seed) for p in parts[i : i + CHUNK]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, fp) per row; ``fp`` as a signed 64-bit integer.  Zero for NULL and empty texts."""
    kind = docs.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column("text")]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), fp], ["row_id", "fp"])

    return docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInArrow(
        run, f"row_id {kind}, fp long"
    )


def _mask(i: int, segments: int) -> int:
    width = 64 // segments
    mask = ((1 << width) - 1) << (width * i)
    return mask - 2**64 if mask >= 2**63 else mask


def blocks(segments: int = SEGMENTS) -> list[range]:
    """The segments in BLOCKS runs."""
    cuts = [segments * k // BLOCKS for k in range(BLOCKS + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def cells(fp: Column, segments: int = SEGMENTS) -> Column:
    """The cells of a fingerprint: block, its bits, and a grid point of the other segments,
    packed into one integer of at most 52 bits."""
    width = 64 // segments
    out = []
    for k, block in enumerate(blocks(segments)):
        low, bits = width * block.start, width * len(block)
        own = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(k << bits)
        others = [i for i in range(segments) if i not in block]
        counts = [F.bit_count(fp.bitwiseAND(F.lit(_mask(i, segments)))) for i in others]
        steps = [(width + 1) ** e for e in range(len(others))]
        point = own * F.lit((width + 1) ** len(others))
        for count, step in zip(counts, steps, strict=True):
            point = point + count.cast("long") * F.lit(step)
        out.append(point)
        for count, step in zip(counts, steps, strict=True):
            # A flipped bit moves the point by one step, up if the bit was clear.
            out.append(F.when(count < width, point + F.lit(step)))
            out.append(F.when(count > 0, point - F.lit(step)))
    return F.array_compact(F.array(*out))


def links(distinct: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: those within 2 bits of each other are
    connected, and every link is between two such."""
    if segments not in (8, 16):
        raise ValueError("a packed grid point needs 8 or 16 segments")
    one = F.lit(1).cast("long")
    placed = distinct.select("fp", F.explode(cells(F.col("fp"), segments)).alias("cell"))
    shared = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    candidates = placed.join(shared, "cell", "left_semi").select("fp").distinct()
    near = F.array(
        F.col("fp"),
        *[F.col("fp").bitwiseXOR(F.shiftleft(one, i)) for i in range(64)],
    )
    met = (
        candidates.select("fp", F.explode(near).alias("via"))
        .groupBy("via")
        .agg(F.collect_set("fp").alias("fps"))  # at most 65
        .where(F.size("fps") > 1)
    )
    return (
        met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where(F.col("a") != F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DIFFERENT_BITS)
        .distinct()
    )


def classes(marked: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint of ``marked`` (row_id, fp).

    ``root`` names the component, ``component_id`` is its smallest row id.
    """
    distinct = materialize(marked.groupBy("fp").agg(F.min("row_id").alias("first")))
    roots = components(materialize(links(distinct, segments)))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(grouped.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", segments: int = SEGMENTS
) -> DataFrame:
    """Per row: (row_id, fingerprint, component_id).

    Rows are linked if their fingerprints differ in at most 2 bits; ``component_id`` is the
    smallest row id that can be reached, the row's own included.  ``fingerprint`` is 16 hex
    digits.

    NULL and empty texts have fingerprint zero and are linked like any other.  Rows with a NULL
    id belong to the component of their fingerprint; a component of only such rows has a NULL
    id.  Repeated rows are kept.  Columns besides the two named ones are ignored.
    """
    marked = materialize(fingerprints(docs, row_id, text))
    return marked.join(classes(marked, segments), "fp").select(
        F.col("row_id").alias(row_id),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", segments: int = SEGMENTS
) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component.

    That is the row with the smallest id; of several such rows, or in a component without ids,
    the one with the smallest fingerprint, then text hash; of rows with the same id and text any
    one.  Rows with one id and different texts are rows of their own.  Columns may have any
    names.  An empty table stays empty.
    """
    mark = F.struct(F.xxhash64(F.col(text)).alias("x"), F.hash(F.col(text)).alias("y"))
    keyed = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), mark.alias("mark"))
    marked = materialize(
        fingerprints(keyed.select(F.struct("row_id", "mark").alias("key"), "text"), "key", "text").select(
            "row_id.row_id", "row_id.mark", "fp"
        )
    )
    first = (
        marked.join(classes(marked, segments), "fp")
        .where(F.col("row_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min(F.struct("fp", "mark", "row_id")).alias("first"))
        .select("first.row_id", "first.mark")
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(row_id).alias("row_id"), mark.alias("mark"))
    kept = rows.alias("r").join(
        first.alias("f"), F.expr("r.row_id <=> f.row_id AND r.mark = f.mark"), "left_semi"
    )
    return kept.dropDuplicates(["row_id", "mark"]).select("row.*")
