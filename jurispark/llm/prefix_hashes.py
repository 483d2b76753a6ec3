"""Document fingerprints from prefix polynomial hashes.

The hash of a text's first i code points, c0 + c1 B + c2 B^2 + ... modulo a prime, is a running
sum.  With it the hash of any span is a difference, moved to the origin by a power of B's inverse;
equal spans have equal hashes, and the longest common extension of two places is a binary search
over span lengths.  The hash of two texts put together follows from those of its parts, so an
edited text is fingerprinted without being read again.

Prefix sums are kept at every ``STRIDE``-th code point; the rest of a place is summed when asked
for, so an array takes a fraction of its text.

A fingerprint is the length, the hash of the whole, and a ladder: hashes of the first and of the
last g code points for g on a geometric grid that is the same for all texts.  Equality of rungs
is monotone in g, so binary search over two ladders finds how far two texts agree from either
end, to within one rung; the likeness is the share of the longer text so covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
STRIDE = 64
CHUNK = 1 << 20  # code points hashed at a time
PER_OCTAVE = 8  # rungs for each doubling of the length
RUNG = 4  # hex digits of a rung


P = np.array(PRIMES, np.uint64)[:, None]  # arrays of hashes have one row per prime


class Powers:
    """Powers of the bases (or of their inverses) modulo their primes, at any exponent."""

    def __init__(self, bases: list[int]):
        self.near = np.array(
            [[pow(b, i, p) for i in range(STRIDE)] for b, p in zip(bases, PRIMES, strict=True)], np.uint64
        )
        self.step = [pow(b, STRIDE, p) for b, p in zip(bases, PRIMES, strict=True)]
        self.far = np.ones((len(bases), 1), np.uint64)  # powers of the stride

    def __call__(self, at: np.ndarray) -> np.ndarray:
        block = at // STRIDE
        while self.far.shape[1] <= block.max(initial=0):
            n = self.far.shape[1]
            jump = [[pow(s, n, p)] for s, p in zip(self.step, PRIMES, strict=True)]
            self.far = np.hstack([self.far, self.far * np.array(jump, np.uint64) % P])
        return self.far[:, block] * self.near[:, at % STRIDE] % P


@cache
def powers() -> Powers:
    return Powers(list(BASES))


@cache
def inverses() -> Powers:
    return Powers([pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)])


def packed(hashes: np.ndarray) -> np.ndarray:
    """The hashes by both primes as one number of 62 bits."""
    return hashes[0] << np.uint64(31) | hashes[1]


@cache
def all_rungs(per_octave: int) -> np.ndarray:
    steps = np.arange(40 * per_octave)
    return np.unique(np.floor(2.0 ** (steps / per_octave)).astype(np.int64))


def grid(n: int, per_octave: int = PER_OCTAVE) -> np.ndarray:
    """The rungs of a text of ``n`` code points: 1 to ``n`` in geometric steps, the same for all."""
    rungs = all_rungs(per_octave)
    return rungs[: np.searchsorted(rungs, n, "right")]


class Prefixes:
    """Prefix hashes of a text: ``at(places)`` are the hashes of its first ``places`` code points."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        self.n = len(self.codes)
        blocks = self.n // STRIDE + 1
        self.sums = np.zeros((len(PRIMES), blocks + 1), np.uint64)
        for first in range(0, blocks, CHUNK // STRIDE):
            last = min(blocks, first + CHUNK // STRIDE)
            part = np.zeros((last - first, STRIDE), np.uint64)
            some = self.codes[first * STRIDE : last * STRIDE]
            part.ravel()[: len(some)] = some
            own = (powers().near @ part.T) % P  # sums of at most 64 products of 21 and 31 bits
            own = own * powers()(np.arange(first, last) * STRIDE) % P
            self.sums[:, first + 1 : last + 1] = (self.sums[:, first : first + 1] + np.cumsum(own, axis=1)) % P

    def at(self, places: np.ndarray) -> np.ndarray:
        block, rest = places // STRIDE, places % STRIDE
        inside = np.arange(STRIDE) < rest[:, None]
        index = np.where(inside, (block * STRIDE)[:, None] + np.arange(STRIDE), 0)
        codes = (self.codes[index] * inside if self.n else index).astype(np.uint64)
        own = (powers().near @ codes.T) % P * powers()(block * STRIDE) % P
        return (self.sums[:, block] + own) % P


class Joined:
    """Prefix hashes of the first ``left`` code points of one text and then ``right`` of another."""

    def __init__(self, one: Prefixes, left: int, two: Prefixes, right: int):
        self.one, self.two, self.left, self.n = one, two, left, left + right

    def at(self, places: np.ndarray) -> np.ndarray:
        cut, beyond = np.array([self.left]), places > self.left
        head = self.one.at(np.append(places[~beyond], self.left))
        out = np.empty((len(PRIMES), len(places)), np.uint64)
        out[:, ~beyond] = head[:, :-1]
        out[:, beyond] = (head[:, -1:] + self.two.at(places[beyond] - self.left) * powers()(cut)) % P
        return out


def spans(text: Prefixes | Joined, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the spans [first, last), equal for equal spans; one ``first`` may serve for all."""
    ends = text.at(np.concatenate([first, last]))
    found = (ends[:, len(first) :] + P - ends[:, : len(first)]) % P
    return packed(found * inverses()(first) % P)


def extension(a: Prefixes | Joined, i: int, b: Prefixes | Joined, j: int) -> int:
    """Length of the longest common extension of a[i:] and b[j:], by binary search.

    Lengths are doubled until the spans differ; each round after that asks for eight spans and
    keeps the gap between the last equal and the first different one.
    """
    low, high = 0, min(a.n - i, b.n - j) + 1  # spans of ``low`` are equal, of ``high`` are not
    tried = 1 << np.arange(8)
    while high - low > 1:
        tried = tried[(tried > low) & (tried < high)]
        if not len(tried):
            tried = np.unique(np.linspace(low, high, 10).astype(np.int64)[1:-1])
            tried = tried[(tried > low) & (tried < high)]
        same = spans(a, np.array([i]), tried + i) == spans(b, np.array([j]), tried + j)
        k = len(tried) if same.all() else int(np.argmin(same))
        low, high = (int(tried[k - 1]) if k else low), (int(tried[k]) if k < len(tried) else high)
        tried = low << np.arange(1, 9) if k == len(same) else tried[:0]
    return low


def fingerprint(text: Prefixes | Joined, per_octave: int = PER_OCTAVE) -> str:
    """Length, hash of the whole, and the ladder of prefixes and suffixes, in hex."""
    rungs = grid(text.n, per_octave)
    cuts = text.n - rungs
    heads = text.at(np.concatenate([[text.n], rungs, cuts]))
    # A suffix is the whole without its head, moved to the origin.
    tails = (heads[:, :1] + P - heads[:, len(rungs) + 1 :]) % P * inverses()(cuts) % P
    found = packed(np.hstack([heads[:, : len(rungs) + 1], tails]))
    short = (found[1:] % np.uint64(16**RUNG)).astype(">u2").tobytes().hex()
    half = RUNG * len(rungs)
    return f"{text.n:x}-{int(found[0]):016x}-{short[:half]}-{short[half:]}"


def agreed(one: str, two: str) -> int:
    """Number of rungs, from the shortest on, on which two ladders agree."""
    low, high = 0, min(len(one), len(two)) // RUNG
    while low < high:
        middle = (low + high + 1) // 2
        if one[RUNG * (middle - 1) : RUNG * middle] == two[RUNG * (middle - 1) : RUNG * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def likeness(one: str, two: str, per_octave: int = PER_OCTAVE) -> float:
    """Share of the longer text that agrees from either end: 1 for equal fingerprints."""
    if one == two:
        return 1.0
    a, b = one.split("-"), two.split("-")
    sizes = int(a[0], 16), int(b[0], 16)
    rungs = grid(min(sizes), per_octave)
    total = sum(int(rungs[k - 1]) for k in (agreed(a[2], b[2]), agreed(a[3], b[3])) if k)
    return min(total, *sizes) / max(sizes)


def _zipped(docs: DataFrame) -> DataFrame:
    """(row_id, digest, z): digests for the order of rows with one id, texts compressed."""
    kind = docs.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [t.as_py().encode() for t in batch.column("text")]
            digest = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
            z = pa.array([tool.compress(t) for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), digest, z], ["row_id", "digest", "z"])

    return docs.mapInArrow(run, f"row_id {kind}, digest binary, z binary")


def _text(z: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z).decode()


RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
          "common_edited", "common_next")
KINDS = ("long", "string", "string", "string", "double", "double", "long", "long")
ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


class Page:
    """A text with its prefix hashes and fingerprint."""

    def __init__(self, z: bytes):
        self.text = _text(z)
        self.prefixes = Prefixes(self.text)
        self.fingerprint = fingerprint(self.prefixes)


def compared(own: Page, following: Page) -> tuple:
    """The columns of RESULT for a text and the one after it."""
    n = own.prefixes.n
    taken = min(n // 3, following.prefixes.n)
    kept = n - n // 3
    edited = Joined(own.prefixes, kept, following.prefixes, taken)
    mark = fingerprint(edited)
    text = own.text[:kept] + following.text[:taken]
    return (
        n,
        hashlib.sha256(text.encode()).hexdigest(),
        own.fingerprint,
        mark,
        likeness(own.fingerprint, mark),
        likeness(own.fingerprint, following.fingerprint),
        kept + extension(own.prefixes, kept, following.prefixes, 0) if taken else kept,
        extension(own.prefixes, 0, following.prefixes, 0),
    )


def _columns(rows: list[tuple]) -> list[pa.Array]:
    made = zip(*rows, strict=True) if rows else [()] * len(RESULT)
    return [pa.array(c, ARROW[k]) for c, k in zip(made, KINDS, strict=True)]


def document_fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and an edited form of it: one row per row of ``docs``.

    In the edited text the last floor(n_chars / 3) code points are replaced by the first as many
    (or all) of the next text: the one with the next smaller id, after the last one the first.

    Columns: row_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness of the fingerprint to that of the edited and of the next text),
    common_edited and common_next (code points that the text shares with their beginning, exact).

    NULL texts are empty; empty texts are like each other (1) and unlike others (0).  Rows with a
    NULL id come last; rows with one id are in descending order of the SHA-256 of their texts, so
    repeated rows are neighbours.  The only row of a table is its own next one.  Other columns
    are ignored, whatever their names.
    """
    source = docs.select(
        F.col(row_id).alias("row_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    kind = source.schema["row_id"].dataType.simpleString()
    order = [F.desc_nulls_last("row_id"), F.desc("digest")]
    ranged = _zipped(source).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["row_id", *RESULT, "part", "side", "z"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose next one is in the same part; of the first and the last row the texts."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple | None = None
        kind_of = None

        def edge(rid: pa.Array, side: int, z: bytes) -> pa.RecordBatch:
            blank = [pa.nulls(1, ARROW[k]) for k in KINDS]
            rest = [pa.array([part], pa.int32()), pa.array([side], pa.int32()), pa.array([z], pa.binary())]
            return pa.RecordBatch.from_arrays([rid, *blank, *rest], names)

        for batch in batches:
            ids, zs = batch.column("row_id"), batch.column("z")
            kind_of = ids.type
            done, made = [], []
            for i in range(batch.num_rows):
                page = Page(zs[i].as_py())
                if last is None:
                    yield edge(ids.slice(i, 1), 0, zs[i].as_py())
                else:
                    done.append(last[0])
                    made.append(compared(last[1], page))
                last = ids[i].as_py(), page, zs[i].as_py()
            if made:
                rest = [pa.nulls(len(made), pa.int32()), pa.nulls(len(made), pa.int32()), pa.nulls(len(made), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(done, kind_of), *_columns(made), *rest], names)
        if last is not None:
            yield edge(pa.array([last[0]], kind_of), 1, last[2])

    schema = f"row_id {kind}, " + ", ".join(f"{c} {k}" for c, k in zip(RESULT, KINDS, strict=True))
    walked = materialize(ranged.mapInArrow(walk, f"{schema}, part int, side int, z binary"))

    # The last row of each part meets the first of the next part that has rows: two texts a part.
    edges = walked.where("side IS NOT NULL")
    parts = edges.where("side = 0").select("part")
    every = W.partitionBy(F.lit(0))  # one small row per part
    ring = parts.select(
        "part", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)).alias("next")
    )
    tails = edges.where("side = 1").select("row_id", "part", F.col("z").alias("own"))
    heads = edges.where("side = 0").select(F.col("part").alias("next"), F.col("z").alias("following"))
    met = tails.join(ring, "part").join(heads, "next").select("row_id", "own", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, following = (Page(batch.column(c)[i].as_py()) for c in ("own", "following"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id").slice(i, 1), *_columns([compared(own, following)])], ["row_id", *RESULT]
                )

    out = walked.where("side IS NULL").select("row_id", *RESULT)
    return out.unionAll(met.mapInArrow(close, schema)).withColumnRenamed("row_id", row_id)
