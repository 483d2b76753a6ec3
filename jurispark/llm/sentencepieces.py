"""SentencePiece encoding with the source bytes of every piece, and decoding.

The model's compiled character map is a double-array trie of prefixes and a pool of their
replacements.  Normalisation walks the text, takes the longest prefix found in the trie at each
place and records, for every byte that it writes, the source byte it stands for.  The pieces
tile the normalised text, so the ends of the pieces, sent through that alignment, tile the
source text.

Ids are those of the sentencepiece library.  Where a model neither rewrites nor removes
characters and no piece has a word boundary inside, each word is encoded alone, and workers
remember frequent words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # fixed: how sentencepiece writes a blank
MAX_CACHED = 200_000
MAX_CACHED_LENGTH = 64
ROWS_OUT = 256  # rows per Arrow batch handed back
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


class CharMap:
    """The compiled character map: trie size, double array, replacements ended by zero bytes."""

    def __init__(self, raw: bytes):
        size = int.from_bytes(raw[:4], "little")
        self.units = np.frombuffer(raw, "<u4", size // 4, 4).tolist()
        self.pool = raw[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of ``text[at:]`` in the map."""
        found, node = None, self._child(self.units[0], 0)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))


class Normalizer:
    """Normalised bytes of a text and the source place of each of them."""

    def __init__(self, spec: bytes):
        # Fixed field numbers and defaults of the normalizer part of a model.
        got = {2: b"", 3: 1, 4: 1, 5: 1} | dict(fields(spec))
        self.chars = CharMap(got[2]) if got[2] else None
        self.dummy_prefix, self.squeeze, self.escape = bool(got[3]), bool(got[4]), bool(got[5])

    def prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        found = self.chars and self.chars.longest(text, at)
        if found:
            return found
        lead = text[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, text[at : at + size]

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """``align`` has one entry more than the bytes: the source place after the last."""
        if not self.chars and not self.squeeze and self.escape:
            return self._plain(text)
        blank = SPACE.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0
        while self.squeeze and at < len(text):
            size, got = self.prefix(text, at)
            if got != b" ":
                break
            at += size
        if at == len(text):
            return b"", np.array([at], np.int64)
        if self.dummy_prefix:
            out += blank
            align += [at] * len(blank)
        after_space = self.squeeze
        while at < len(text):
            size, got = self.prefix(text, at)
            if after_space:
                got = got.lstrip(b" ")
            if got:
                written = got.replace(b" ", blank)
                out += written
                align += [at] * len(written)
                after_space = got.endswith(b" ")
            at += size
            after_space = after_space and self.squeeze
        end = len(text)
        while self.squeeze and out.endswith(blank):
            del out[-len(blank) :]
            end = align[-len(blank)]
            del align[-len(blank) :]
        return bytes(out), np.array([*align, end], np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """No map, nothing removed: only blanks change, from one byte to three."""
        if not text:
            return b"", np.zeros(1, np.int64)
        source = np.frombuffer(text, np.uint8)
        align = np.repeat(np.arange(len(source)), np.where(source == 32, 3, 1))
        lead = [0] * 3 if self.dummy_prefix else []
        mark = SPACE.encode()
        return mark[: len(lead)] + text.replace(b" ", mark), np.concatenate([lead, align, [len(text)]])


class Pieces:
    """A model: encoding with source ends, and decoding."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces, normalizer, trainer = [], b"", {}
        for number, value in fields(raw):
            if number == 1:
                pieces.append({3: NORMAL} | dict(fields(value)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = value
        self.normalize = Normalizer(normalizer)
        kinds = [p[3] for p in pieces]
        if BYTE not in kinds:
            raise ValueError("spans need a model that writes unknown characters as bytes")
        text = [p[1].decode() for p in pieces]
        self.sizes = np.array(
            [
                1 if k == BYTE else len(p.encode()) if k in (NORMAL, USER_DEFINED) else 0
                for p, k in zip(text, kinds, strict=True)
            ],
            np.int64,
        )
        self.eos = self.library.eos_id()
        n, suffix = self.normalize, 24  # fixed field number: blanks at the end of words
        self.by_word = (
            not (n.chars or n.squeeze or trainer.get(suffix))
            and n.dummy_prefix
            and n.escape
            and not any(SPACE in p.lstrip(SPACE) for p in text)
        )
        self.blank = np.array([self.library.piece_to_id(SPACE)], np.int32).tobytes()
        self.cache: dict[str, bytes] = {}
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @classmethod
    def of(cls, path: str) -> Pieces:
        """The model of this worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _words(self, text: str) -> list[str]:
        """Parts that no merge crosses.  Each stands for itself after a word boundary."""
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [c[1:] for c in self.chunk.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        if not self.by_word:
            return [np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)]
        parts = [self._words(t) for t in texts]
        wanted = set(chain.from_iterable(parts))
        new = [w for w in wanted if w not in self.cache]
        if len(self.cache) + len(new) > MAX_CACHED:
            self.cache.clear()
            new = list(wanted)
        ids = self.library.encode(new, num_threads=1)
        self.cache.update(
            (w, np.array(x, np.int32).tobytes() if w else self.blank)
            for w, x in zip(new, ids, strict=True)
        )
        got = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(got, p)), np.int32) for p in parts]
        for w in new:
            if len(w) > MAX_CACHED_LENGTH:
                del self.cache[w]
        return out

    def ends(self, text: str, ids: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the first piece starts and each piece ends in the UTF-8 bytes of ``text``."""
        written, align = self.normalize(text.encode())
        ends = np.cumsum(self.sizes[ids])
        if len(ids) and ends[-1] != len(written):
            raise ValueError("the pieces do not tile the normalised text")
        return int(align[0]), align[ends].astype(np.int32)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(
    docs: DataFrame,
    model: str,
    row_id: str = "doc_id",
    text: str = "text",
    end: bool = True,
    decoded: bool = True,
) -> DataFrame:
    """Per row: (row_id, ids, start, ends[, decoded]).

    ``ids`` are those of the library, with the end id if ``end``.  Piece i covers the UTF-8
    bytes ``ends[i-1] .. ends[i]`` of the source text, the first one from ``start`` on; ids
    without text cover nothing.  ``decoded`` is what the library makes of the ids again.

    A NULL text counts as empty (just the end id, decoded to ""); NULL and repeated row ids
    are kept as they are; columns besides the two named ones are ignored.
    """
    kind = docs.schema[row_id].dataType
    schema = f"row_id {kind.simpleString()}, ids array<int>, start int, ends array<int>"
    schema += ", decoded string" if decoded else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        tail = np.array([pieces.eos] if end else [], np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = [np.concatenate([x, tail]) for x in pieces.encode(texts)]
                spans = [pieces.ends(t, x) for t, x in zip(texts, ids, strict=True)]
                columns = {
                    "row_id": batch.column("row_id"),
                    "ids": _lists(ids),
                    "start": pa.array([s for s, _ in spans], pa.int32()),
                    "ends": _lists([e for _, e in spans]),
                }
                if decoded:
                    columns["decoded"] = pa.array(
                        [pieces.library.decode(x.tolist()) for x in ids], pa.string()
                    )
                yield pa.RecordBatch.from_pydict(columns)

    return (
        docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
        .mapInArrow(run, schema)
        .withColumnRenamed("row_id", row_id)
    )


def decode(encoded: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of an id list; NULL for NULL, "" for an empty list."""

    def text(column: pd.Series) -> pd.Series:
        library = Pieces.of(model).library
        return column.map(lambda x: None if x is None else library.decode([int(i) for i in x]))

    text = F.pandas_udf(text, "string")
    return encoded.withColumn(into, text(F.col(ids)))


def digests(encoded: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Counts and digests of ids, source coverage and decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        row_id,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.coalesce(F.try_element_at("ends", F.lit(-1)), "start") - F.col("start")).alias(
            "covered_bytes"
        ),
    )
