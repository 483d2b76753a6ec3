"""Removal of repeated word windows through FM-indexes of shards.

Which windows can be equal.  Of the hashes of the word ``GRAM``-grams in a window, the smallest is
its minimizer; equal windows have equal minimizers.  Consecutive windows with the same minimizer
form a span.  Spans whose minimizer occurs nowhere else hold no repeat and are dropped, which is
most of the corpus.  The others go to the shard of their minimizer, once each: of identical spans
only the earliest is indexed, and all windows of the later ones are repeats of it.

Which windows are equal.  A shard is an FM-index of its distinct spans (words, not hashes).
Backward search finds for every window the interval of all its occurrences; the earliest in
document order stays, the others are reported.

A minimizer with very many spans (a line that a large part of all documents share) would fill a
shard alone.  Its spans are cut into single windows, which go to shards by the hash of the whole
window; equal windows still meet, and a shared line no longer ties their surroundings together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .fm_index import FMIndex

WINDOW = 20
GRAM = 6
HOT_SPANS = 1_000  # spans of one minimizer beyond which they are cut into windows
SPANS_PER_SHARD = 40_000
ROWS = 250  # documents whose spans are cut out together
MAX_WAITING = 100_000  # spans that a task holds before it sends them
BLOCKS = "shard int, block binary, doc long, th long, start int, many int"
GROUP = 2_000_000  # bytes of text looked at together
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # on bytes: exactly the six blanks


def text_groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in runs of about GROUP characters; a longer text is one run."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def spans(texts: list[str | None], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, minimizer, first window, number of windows, repeats inside) of all spans."""
    import xxhash

    numbers: dict[bytes, int] = {}
    sizes, flat = [], []
    for t in texts:
        w = words_of(t)
        if len(w) < window:  # no window
            w = []
        flat.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), np.int64, len(w)))
        sizes.append(len(w))
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not sum(sizes):
        return empty
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
    word = hashes[np.concatenate(flat)]
    n, count = len(word), np.array(sizes)
    g = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        g = g * MULTIPLIER + word[j : j + len(g)]
    g = (g ^ (g >> np.uint64(29))) * MIXER
    g ^= g >> np.uint64(32)
    reach = window - gram + 1  # grams in a window
    least = np.full(n - window + 1, np.uint64(2**64 - 1))
    for j in range(reach):
        np.minimum(least, g[j : j + len(least)], out=least)
    # A window can only repeat inside its span if a gram comes again within a window's reach.
    again = np.zeros(len(g), bool)
    for d in range(1, reach + 1):
        again[: len(g) - d] |= g[d:] == g[: len(g) - d]
    seen = np.concatenate([[0], np.cumsum(again)])
    owner = np.repeat(np.arange(len(count)), count)
    start = np.cumsum(count) - count
    at = np.arange(len(least))
    at = at[at - start[owner[: len(least)]] <= count[owner[: len(least)]] - window]
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(at)))
    begin = at[first]
    inside = seen[begin + many + reach - 1] > seen[begin]
    doc = owner[begin]
    return doc, least[begin].view(np.int64), begin - start[doc], many, inside.astype(np.int64)


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of ``n`` words, those in one of ``counts`` windows from ``starts`` on."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + window - 1, -1)
    return np.cumsum(change)[:n] > 0


def runs(found: list[tuple]) -> list[tuple]:
    """(document ..., start, many): what overlaps or follows on within a document as one run."""
    out: list[tuple] = []
    for *doc, start, many in sorted(found, key=lambda r: (r[0] is not None, *(x or 0 for x in r))):
        if out and list(out[-1][:-2]) == doc and start <= out[-1][-2] + out[-1][-1]:
            first = out[-1][-2]
            out[-1] = (*doc, first, max(out[-1][-1], start + many - first))
        else:
            out.append((*doc, start, many))
    return out


def repeated_windows(
    texts: list[list[bytes]], order: np.ndarray, window: int = WINDOW
) -> Iterator[tuple[int, int]]:
    """(span, window in it) of all windows that also occur earlier, in the spans ``texts``.

    ``order`` has the place of the first window of each span in document order; the windows of
    a span follow one another.
    """
    numbers: dict[bytes, int] = {}
    coded = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int64, len(t)) for t in texts]
    index = FMIndex(coded, len(numbers))
    many = np.array([len(t) for t in texts]) - window + 1
    span = np.repeat(np.arange(len(texts)), many)
    offset = np.arange(len(span)) - np.repeat(np.cumsum(many) - many, many)
    low, high = index.intervals(index.starts[span] + offset, window)
    met = np.flatnonzero(high - low > 1)
    # All occurrences of a window are among the searched ones, and share the interval.
    interval = np.unique(low[met], return_inverse=True)[1]
    place = order[span[met]] + offset[met]
    earliest = np.full(interval.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, interval, place)
    for i in met[place > earliest[interval]]:
        yield int(span[i]), int(offset[i])


def _same(left: str, right: str) -> Column:
    return F.expr(f"{left}.doc <=> {right}.doc AND {left}.th = {right}.th")


def _compressed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts as zstd bytes: a third of what shuffling them as they are would write."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [None if t is None else tool.compress(t.encode()) for t in batch.column("text").to_pylist()]
            others = [batch.column(f"c_{c}") for c in carry]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("th"), pa.array(packed, pa.binary()), *others],
                ["doc", "th", "z", *[f"c_{c}" for c in carry]],
            )

    schema = "doc long, th long, z binary" + "".join(f", `c_{c}` string" for c in carry)
    return docs.mapInArrow(run, schema)


def _plain(z: bytes | None) -> str | None:
    import zstandard

    return None if z is None else zstandard.ZstdDecompressor().decompress(z).decode()


def occurrences(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, th, h, part): every span; ``part`` holds first window, number of windows and
    whether it may repeat inside (32, 31 and 1 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_groups(batch.column("text").to_pylist()):
                doc, h, start, many, inside = spans(texts, window)
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(rows),
                        batch.column("th").take(rows),
                        pa.array(h),
                        pa.array(start << 32 | many << 1 | inside),
                    ],
                    ["doc", "th", "h", "part"],
                )

    return docs.mapInArrow(run, "doc long, th long, h long, part long")


def candidate_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """(shard, block, doc, th, start, many), and the number of shards.

    A row is either a run of windows known to be repeats (``block`` NULL), or a block of spans for
    a shard: of equal spans that a task has seen only the earliest is sent, the later ones are
    repeats of it.  Spans of a hot minimizer are sent as single windows, under the hash of the
    window.  A block is compressed as a whole.
    """
    weight = F.lit(1) + F.col("part").bitwiseAND(F.lit(1).cast("long"))
    same = W.partitionBy("h")
    marked = written(
        occurrences(docs, window)
        .withColumn("n", F.sum(weight).over(same))
        .withColumn("hot", F.count(F.lit(1)).over(same) > HOT_SPANS)
        .where("n > 1")
        .groupBy("doc", "th")
        .agg(F.collect_set(F.struct("h", "part", "hot")).alias("spans")),
        "zstd",
    )
    total = marked.agg(F.sum(F.size("spans"))).first()[0] or 0
    shards = max(1, -(-total // SPANS_PER_SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: dict[tuple[int, bytes], tuple] = {}  # (minimizer, words) -> earliest place
        again: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            parts: dict[int, list[tuple]] = {}
            for (h, raw), (key, many) in seen.items():
                parts.setdefault(h % shards, []).append((key, raw))
            seen.clear()
            for shard, rows in parts.items():
                yield _rows([(shard, _block(rows), None, None, None, None)])
            joined = runs(again)
            for i in range(0, len(joined), 50_000):
                yield _rows([(None, None, *r) for r in joined[i : i + 50_000]])
            again.clear()

        def add(h: int, raw: bytes, key: tuple, many: int) -> None:
            old = seen.get((h, raw))
            if old is None or key < old[0]:
                seen[h, raw] = key, many
                key, many = old or (None, 0)
            if key is not None and key != seen[h, raw][0]:
                again.append((*key[1:], many))

        # A few rows at a time: as Python objects the spans of a batch are many times its size.
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            for row in batch.to_pylist():
                w = words_of(_plain(row["z"]))
                for x in row["spans"]:
                    start, many = x["part"] >> 32, (x["part"] & 0xFFFFFFFF) >> 1
                    place = row["doc"] is not None, row["doc"], row["th"]
                    if x["hot"]:
                        for i in range(start, start + many):
                            raw = b" ".join(w[i : i + window])
                            add(xxhash.xxh64_intdigest(raw) >> 1, raw, (*place, i), 1)
                    else:
                        raw = b" ".join(w[start : start + many + window - 1])
                        add(x["h"], raw, (*place, start), many)
            if len(seen) + len(again) > MAX_WAITING:
                yield from flush()
        yield from flush()

    z = _compressed(docs)
    both = z.alias("z").join(marked.alias("m"), _same("z", "m"))
    found = both.select("z.doc", "z.th", "z.z", "m.spans").mapInArrow(run, BLOCKS)
    return written(found, "none"), shards


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        ["shard", "block", "doc", "th", "start", "many"],
    )


def _block(rows: list[tuple[tuple, bytes]]) -> bytes:
    """Spans with their places, in document order, as one compressed block."""
    import zstandard

    rows.sort(key=lambda r: r[0])
    named = np.array([k[0] for k, _ in rows], "<i1")
    doc, th = (np.array([k[i] or 0 for k, _ in rows], "<i8") for i in (1, 2))
    start = np.array([k[3] for k, _ in rows], "<i4")
    raw = b"".join(
        [len(rows).to_bytes(8, "little"), named.tobytes(), doc.tobytes(), th.tobytes(), start.tobytes()]
    )
    return zstandard.ZstdCompressor(level=3).compress(raw + b"\n".join(r for _, r in rows))


def _unblock(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in ("<i1", "<i8", "<i8", "<i4"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return *out, raw[at:].split(b"\n")  # a word holds no line feed


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, th, start, many): runs of windows that also occur earlier."""
    found, shards = candidate_spans(docs, window)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                blocks.setdefault(row["shard"], []).append(row["block"])
        for shard in blocks.values():
            opened = [_unblock(b) for b in shard]
            named, doc, th, start = (np.concatenate([o[i] for o in opened]) for i in range(4))
            spans = [t for o in opened for t in o[4]]
            order = np.lexsort((start, th, doc, named))  # document order, NULL ids first
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(doc[order]) != 0) | (np.diff(th[order]) != 0) | (np.diff(named[order]) != 0)
            place = np.empty(len(order), np.int64)
            place[order] = (np.cumsum(new) - 1) << 32 | start[order]
            # Equal spans from different tasks: the earliest is indexed.
            first: dict[bytes, int] = {}
            later = []
            for i in order.tolist():
                if spans[i] in first:
                    if place[first[spans[i]]] != place[i]:  # not the same row again
                        later.append(i)
                else:
                    first[spans[i]] = i
            kept = np.array(list(first.values()))
            words = [spans[i].split(b" ") for i in kept]
            hits = list(repeated_windows(words, place[kept], window))
            at = np.array(later + [int(kept[i]) for i, _ in hits], np.int64)
            begin = start[at] + np.array([0] * len(later) + [o for _, o in hits], np.int32)
            many = [len(spans[i].split(b" ")) - window + 1 for i in later] + [1] * len(hits)
            owners = [d if k else None for d, k in zip(doc[at].tolist(), named[at], strict=True)]
            joined = runs(list(zip(owners, th[at].tolist(), begin.tolist(), many, strict=True)))
            columns = zip(*joined, strict=True) if joined else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc", "th", "start", "many"],
            )

    indexed = (
        found.where("block IS NOT NULL")
        .select("shard", "block")
        .repartition(shards, "shard")
        .mapInArrow(search, "doc long, th long, start int, many int")
    )
    known = found.where("block IS NULL").select("doc", "th", "start", "many")
    return indexed.unionAll(known)


def deduplicate(
    docs: DataFrame,
    window: int = WINDOW,
    row_id: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Per row: (row_id, n_words, n_removed, kept), kept words joined by one space.

    With ``carry``, the text as it was (``text``) and the columns named there, strings, follow;
    a name that the result has already gets an underscore at its end.

    A word goes if it lies in a window of ``window`` consecutive words of its text whose words
    also start earlier: in a row with a smaller id, or earlier in the same row.  Windows are
    judged on the input.  Words are runs of bytes other than the six ASCII blanks.

    NULL and short texts lose nothing; a NULL text has no words.  Rows with a NULL id come
    before all others.  Rows with the same id are in the order of a 64-bit hash of their texts; equal
    rows with equal ids are one document and share its result.  Other columns are ignored.
    """
    source = docs.select(
        F.col(row_id).cast("long").alias("doc"),
        F.xxhash64(F.col(text)).alias("th"),
        F.col(text).cast("string").alias("text"),
    )
    found = repeats(source, window)
    names = tuple(carry or ())
    source = docs.select(
        F.col(row_id).cast("long").alias("doc"),
        F.xxhash64(F.col(text)).alias("th"),
        F.col(text).cast("string").alias("text"),
        *[F.col(c).cast("string").alias(f"c_{c}") for c in names],
    )
    runs = found.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "many")).alias("runs"))
    z = _compressed(source, names)
    extra = [f"z.c_{c}" for c in names]
    both = z.alias("z").join(runs.alias("r"), _same("z", "r"), "left").select("z.doc", "z.z", "r.runs", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, removed, kept, plain = [], [], [], []
                for z, r in zip(part.column("z").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    plain.append(_plain(z))
                    w = words_of(plain[-1])
                    counts.append(len(w))
                    if r:
                        begin = np.array([x["start"] for x in r], np.int64)
                        many = np.array([x["many"] for x in r], np.int64)
                        gone = covered(len(w), begin, many, window)
                        w = [w[i] for i in np.flatnonzero(~gone)]
                    removed.append(counts[-1] - len(w))
                    kept.append(b" ".join(w).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        pa.array(counts, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.string()),
                        *([] if carry is None else [pa.array(plain, pa.string())]),
                        *[part.column(f"c_{c}") for c in names],
                    ],
                    columns,
                )

    own = [row_id, "n_words", "n_removed", "kept", *([] if carry is None else ["text"])]
    columns = [*own, *[f"{c}_" if c in own else c for c in names]]
    kinds = ["long", "long", "long"] + ["string"] * (len(columns) - 3)
    return both.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds, strict=True)))


# All windows as strings in DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x) AS ws
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20),
keyed AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS k FROM win JOIN w USING (doc_id)),
ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM keyed),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM ranked WHERE r > 1),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
one AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
