"""Collocations by marginalising the counts of the longest windows.

Every word position gives one window: the word and the ones that follow it in its piece, padded
where the piece ends.  Only these windows are counted; a Spark ROLLUP over their columns sums
them to the counts of every shorter phrase (a phrase begins at exactly the positions whose
windows start with it) and to the number of words.

Windows are many and mostly rare, so they are counted twice before Spark sees them as rows.  A
map task counts its windows as integers and sends them, packed, to buckets of bounded size.  A
bucket merges them and pads after its first word every window whose first two words together
occur less than ``min_count`` times: no phrase of that window can be a candidate, and its first
word still counts.  For that the windows of a pair go to the pair's bucket.  A pair that is
frequent within one map task is frequent, so its windows need no such bucket: they are dealt out by all
their words, and the pair's bucket gets a mark.  No bucket holds a hot pair.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize

LONGEST = 3
MIN_COUNT = 10
COVERED = 50  # percent of a phrase's occurrences inside a longer candidate that drop it
TOP = 2_000
UNIT = 1_000_000
SCORERS = 64  # parts of a language that are ranked apart before the last ranking
# Fixed by the contract: what ends a piece.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
SLICE = 1_000_000  # bytes of a text cut into pieces at a time
WAITING = 1_500_000  # words that a map task counts together
BUCKET_CHARS = 8_000_000
PAD, MARK = 0, -1  # no word; a window that only says its pair is frequent
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = ("w1", "w2", "w3")


def numbering() -> dict[bytes, int]:
    """Words get the numbers 1, 2, ... as they are looked up."""
    out: dict[bytes, int] = defaultdict()
    out.default_factory = lambda: len(out) + 1
    return out


def pieces(text: str) -> Iterator[list[bytes]]:
    """Words of each piece; ASCII capitals in lower case.  Long texts go slice by slice."""
    raw, at = text.encode().lower().translate(ENDS), 0
    while at < len(raw):
        end = raw.find(b"\n", at + SLICE)
        end = len(raw) if end < 0 else end
        for line in raw[at:end].split(b"\n"):
            if words := line.split():
                yield words
        at = end


def windows(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LONGEST x n: each word with the ones after it, PAD past the end of its piece."""
    n = len(words)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the end
    out = np.zeros((LONGEST, n), np.int64)
    for k in range(LONGEST):
        out[k, : n - k] = np.where(left[: n - k] > k, words[k:], PAD)
    return out


def counted(window: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different windows in order of their word numbers, and the sums of ``n``."""
    pair = window[0] * (words + 1) + window[1]
    order = np.lexsort((window[2], pair))
    pair, last = pair[order], window[2, order]
    new = np.ones(len(order), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (last[1:] != last[:-1])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(n[order], first) if len(first) else n[:0]
    return window[:, order[first]], sums


def pair_runs(window: np.ndarray) -> np.ndarray:
    """Where runs of the same first two words begin, in ordered windows."""
    new = np.ones(window.shape[1], bool)
    new[1:] = (window[0, 1:] != window[0, :-1]) | (window[1, 1:] != window[1, :-1])
    return np.flatnonzero(new)


def pack(words: list[bytes], window: np.ndarray, n: np.ndarray) -> bytes:
    """Windows over ``words`` (numbered from 1) with their counts; only the words used are kept."""
    import zstandard

    used = np.unique(window)
    used = used[used > PAD]
    near = np.where(window > PAD, np.searchsorted(used, window) + 1, window).astype("<i4")
    near[0, 1:] = np.diff(near[0])  # in order, so mostly zeros
    head = np.array([window.shape[1], len(used)], "<i8").tobytes()
    body = [head, near.tobytes(), n.astype("<i8").tobytes(), b"\n".join(words[i - 1] for i in used)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpack(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    rows, used = np.frombuffer(raw, "<i8", 2).tolist()
    window = np.frombuffer(raw, "<i4", LONGEST * rows, 16).reshape(LONGEST, rows).astype(np.int64)
    window[0] = np.cumsum(window[0])
    at = 16 + 4 * LONGEST * rows
    n = np.frombuffer(raw, "<i8", rows, at)
    return raw[at + 8 * rows :].split(b"\n") if used else [], window, n


def dealt(words: list[bytes], window: np.ndarray, n: np.ndarray, buckets: int, min_count: int) -> Iterator[tuple]:
    """(bucket, sure, block) of counted windows in order; ``sure``: their pairs are frequent."""
    import xxhash

    if not len(n):
        return
    hashes = np.zeros(len(words) + 1, np.uint64)
    hashes[1:] = [xxhash.xxh64_intdigest(w) for w in words]

    def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
        h = (before + hashes[word]) * MULTIPLIER
        return h ^ (h >> np.uint64(29))

    pair = mixed(mixed(np.uint64(0), window[0]), window[1])
    whole = mixed(pair, window[2])
    first = pair_runs(window)
    often = (np.add.reduceat(n, first) >= min_count) & (window[1, first] != PAD)
    sure = np.repeat(often, np.diff(np.append(first, len(n))))
    marks = window[:, first[often]].copy()
    marks[2] = MARK
    for flag, part, count, key in (
        (True, window[:, sure], n[sure], whole[sure]),
        (False, np.hstack([window[:, ~sure], marks]), np.append(n[~sure], np.zeros(often.sum(), n.dtype)),
         np.append(pair[~sure], pair[first[often]])),
    ):
        bucket = (key >> np.uint64(8)) % np.uint64(buckets)
        order = np.lexsort((part[1], part[0], bucket))
        bucket, part, count = bucket[order], part[:, order], count[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            if a < b:
                yield int(bucket[a]), flag, pack(words, part[:, a:b], count[a:b])


def sent(docs: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """(bucket, lang, sure, block): the windows of ``docs`` (lang, text), counted per map task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[bytes, int]] = defaultdict(numbering)
        held: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (flat, sizes) in held.items():
                words = list(numbers[lang])
                window = windows(np.array(flat, np.int64), np.array(sizes, np.int64))
                window, n = counted(window, np.ones(window.shape[1], np.int64), len(words))
                blocks = list(dealt(words, window, n, buckets, min_count))
                for i in range(0, len(blocks), 100):
                    bucket, sure, block = zip(*blocks[i : i + 100], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket, pa.int32()),
                            pa.array([lang] * len(bucket), pa.string()),
                            pa.array(sure, pa.bool_()),
                            pa.array(block, pa.binary()),
                        ],
                        ["bucket", "lang", "sure", "block"],
                    )
            numbers.clear()
            held.clear()

        waiting = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                number, (flat, sizes) = numbers[lang], held[lang]
                for words in pieces(text.as_py()):
                    flat.extend(map(number.__getitem__, words))
                    sizes.append(len(words))
                    waiting += len(words)
                    if waiting > WAITING:  # between pieces: no window is cut
                        yield from flush()
                        waiting, number, (flat, sizes) = 0, numbers[lang], held[lang]
        yield from flush()

    return docs.mapInArrow(run, "bucket int, lang string, sure boolean, block binary")


def merged(blocks: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The windows of several blocks over one list of words, equal ones added up."""
    number, parts = numbering(), []
    for words, window, _ in blocks:
        place = np.array([*map(number.__getitem__, words), 0], np.int64)  # word 0 never looked up
        parts.append(np.where(window > PAD, place[window - 1], window))
    window, n = np.hstack(parts), np.concatenate([n for _, _, n in blocks])
    window, n = counted(window, n, len(number))
    return list(number), window, n


def padded(window: np.ndarray, n: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of rare pairs as their first word alone; marks go."""
    first = pair_runs(window)
    many = np.diff(np.append(first, len(n)))
    marked = np.add.reduceat(window[2] == MARK, first) > 0 if len(first) else first > 0
    often = (np.add.reduceat(n, first) >= min_count) | marked if len(first) else marked
    rare = ~np.repeat(often, many)
    out = window.copy()
    out[1:, rare] = PAD
    real = window[2] != MARK
    return out[:, real], n[real]


def window_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, w1, w2, w3, n): counts of windows of ``docs`` (lang, text), NULL where padded."""
    size = docs.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                held[row["bucket"], row["lang"], row["sure"]].append(row["block"])
        for (_, lang, sure), blocks in sorted(held.items()):
            words, window, n = merged([unpack(b) for b in blocks])
            blocks.clear()
            if not sure:
                window, n = padded(window, n, min_count)
                window, n = counted(window, n, len(words))
            names = pa.array([None, *words], pa.binary()).cast(pa.string())
            for i in range(0, len(n), 100_000):
                part = window[:, i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * part.shape[1], pa.string()),
                        *[names.take(pa.array(column)) for column in part],
                        pa.array(n[i : i + 100_000]),
                    ],
                    ["lang", *COLUMNS, "n"],
                )

    return sent(docs, buckets, min_count).repartition(buckets, "bucket").mapInArrow(
        run, "lang string, w1 string, w2 string, w3 string, n long"
    )


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, w1, w2, w3, words, f): all phrases with f >= ``min_count`` and the number of words
    of each language (``words`` = 0), by one ROLLUP over the counted windows."""
    sums = window_counts(docs, min_count).rollup("lang", *COLUMNS).agg(
        F.sum("n").alias("f"), F.grouping_id().alias("level")
    )
    order = F.when(F.col("level") == 0, 3).when(F.col("level") == 1, 2).when(F.col("level") == 3, 1)
    last = F.when(F.col("level") == 0, F.col("w3")).when(F.col("level") == 1, F.col("w2")).otherwise(F.col("w1"))
    return materialize(
        sums.where("level < 15")
        .withColumn("words", F.coalesce(order, F.lit(0)))
        .where((F.col("words") == 0) | (last.isNotNull() & (F.col("f") >= min_count)))
        .select("lang", *COLUMNS, "words", "f")
    )


def _scored(table: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score): the lowest-scoring cut of each phrase of 2 or 3 words."""
    def with_part(df: DataFrame, name: str, *words: str) -> DataFrame:
        """The count of the phrase in the columns ``words``, as ``name``."""
        part = table.where(F.col("words") == len(words))
        columns = [F.col(k).alias(w) for k, w in zip(COLUMNS, words, strict=False)]
        return df.join(part.select("lang", *columns, F.col("f").alias(name)), ["lang", *words])

    def cut(left: str, right: str, k: int) -> Column:
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        square = (wide("f") * wide("f")).cast("decimal(31,0)") * F.lit(UNIT).cast("decimal(7,0)")
        score = F.call_function("div", square, wide(left) * wide(right))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    pairs = with_part(with_part(table.where("words = 2"), "x", "w1"), "y", "w2")
    triples = with_part(with_part(table.where("words = 3"), "x", "w1"), "yz", "w2", "w3")
    triples = with_part(with_part(triples, "xy", "w1", "w2"), "z", "w3")
    out = pairs.select("lang", *COLUMNS, "f", cut("x", "y", 1).alias("cut"))
    out = out.unionAll(
        triples.select("lang", *COLUMNS, "f", F.least(cut("x", "yz", 1), cut("xy", "z", 2)).alias("cut"))
    )
    return out.select("lang", *COLUMNS, F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    covered: int = COVERED,
    top: int = TOP,
) -> DataFrame:
    """The first ``top`` phrases of 2 and 3 words per language: (lang, rank, phrase, a, l, r, n,
    score).

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs;
    A-Z are lower-cased.  ``a`` counts all occurrences within pieces; only phrases with at least
    ``min_count`` are candidates.  A cut after the first words gives the counts ``l`` and ``r``
    of its sides and the score floor(10^6 a a / (l r)), exactly; the lowest counts, of equal ones
    the one after fewer words.  A candidate goes if a longer one holds it and has at least
    ``covered`` percent of its occurrences.  ``n`` is the number of words of the language.  Order:
    score and a descending, phrase ascending by its bytes.

    NULL texts are empty, a NULL language is ``und``.  Empty tables and languages without
    candidates give no rows; repeated rows count as often as they occur.  Columns besides the two
    named ones are ignored, whatever their names.
    """
    source = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    table = phrase_counts(source, min_count)
    longer = table.where("words = 3")
    inside = (
        longer.select("lang", "w1", "w2", "f")
        .unionAll(longer.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
        .groupBy("lang", "w1", "w2")
        .agg(F.max("f").alias("most"))
    )
    scored = _scored(table)
    pairs = scored.where("w3 IS NULL").join(inside, ["lang", "w1", "w2"], "left")
    pairs = pairs.where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    found = scored.where("w3 IS NOT NULL").unionAll(pairs.select(*scored.columns)).select(
        "lang", F.concat_ws(" ", *COLUMNS).alias("phrase"), "a", "l", "r", "score"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SCORERS))).orderBy(*order)
    first = found.withColumn("_rank", F.row_number().over(parted)).where(F.col("_rank") <= top).drop("_rank")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    total = table.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


# The same phrases in DuckDB, every order counted apart.
SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
pos AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
total AS (SELECT lang, count(*) AS n FROM pos GROUP BY lang),
g1 AS (SELECT lang, ws[i] AS x, count(*) AS f FROM pos GROUP BY ALL),
g2 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f FROM pos WHERE i + 1 <= len(ws)
       GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f FROM pos
       WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, g2.x || ' ' || g2.y AS phrase, g2.f AS a, 1 AS k, b.f AS l, c.f AS r
  FROM g2 JOIN g1 b USING (lang) JOIN g1 c USING (lang) WHERE b.x = g2.x AND c.x = g2.y
  UNION ALL
  SELECT lang, g3.x || ' ' || g3.y || ' ' || g3.z, g3.f, 1, b.f, c.f
  FROM g3 JOIN g1 b USING (lang) JOIN g2 c USING (lang) WHERE b.x = g3.x AND c.x = g3.y AND c.y = g3.z
  UNION ALL
  SELECT lang, g3.x || ' ' || g3.y || ' ' || g3.z, g3.f, 2, b.f, c.f
  FROM g3 JOIN g2 b USING (lang) JOIN g1 c USING (lang) WHERE b.x = g3.x AND b.y = g3.y AND c.x = g3.z),
scored AS (
  SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, x || ' ' || y AS phrase, f FROM g3 UNION ALL SELECT lang, y || ' ' || z, f FROM g3)
  GROUP BY ALL),
ranked AS (
  SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN held USING (lang, phrase)
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
