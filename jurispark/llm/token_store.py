"""Token ids of documents as raw binary shards with a minimal perfect hash index.

File format.  ``shard-NNNNN.ids`` holds the ids of its documents, one after another, as
little-endian unsigned integers of 2 bytes (4 if the vocabulary needs them).
``shard-NNNNN.idx`` holds 8 bytes of magic, the length of a JSON header (8 bytes), the header,
and the arrays that it names: where each document starts, its key, and the index: bits of the
perfect hash and, by hash number, the fingerprint of the key, its first document and how many
documents follow under the same key.  ``manifest`` is a Parquet table with a row per shard.

Documents are range-partitioned and sorted by id, so shard after shard is ascending order.
Each task writes its shard under a name of its own and moves it into place when complete, so
a task that is run again, or twice at once, leaves the same files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash, fingerprints

MAGIC = b"JSTOK\x01\x00\x00"
MAX_CACHED = 600_000  # words whose ids a worker remembers
MAX_CACHED_LENGTH = 64
INNER_CUT = re.compile(r"(?= \S)")
SPACE_RUN = re.compile(r" \s")
MANIFEST = "shard long, n_docs long, n_tokens long, min_key long, max_key long, path string"


class ByteEncoder:
    """Whole texts to ids with the tokenizers library, remembering the ids of frequent words.

    With a byte-level pre-tokenizer no piece crosses the place before a single space that a
    visible character follows: what stands between two such places can be encoded alone.
    Texts with special tokens, and other kinds of tokenizers, go to the library whole.
    """

    _loaded: dict[str, ByteEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_word = (
            spec["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        # Byte 0x20 is written as U+0120 (fixed); a word has it in front of its first piece only.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens_word[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.first: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        """The encoder of this worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def words(self, words: list[str], at_a_time: int = 1_000) -> list[bytes]:
        """Raw ids of each word after a space.  The library gets many words as one text, and
        the pieces that begin with the space show where one word ends and the next begins."""
        width, out = self.dtype.itemsize, []
        groups = [words[i : i + at_a_time] for i in range(0, len(words), at_a_time)]
        for raw in self.whole([" " + " ".join(g) for g in groups]):
            at = np.flatnonzero(self.opens_word[np.frombuffer(raw, self.dtype)]) * width
            ends = [*at[1:].tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(at.tolist(), ends, strict=True)]
        return out

    def _learn(self, cache: dict[str, bytes], words: set[str], prefix: str) -> list[str]:
        """Put the ids of all ``words`` into ``cache``; returns those too long to stay there."""
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > MAX_CACHED:
            cache.clear()
            new = list(words)
        if prefix:
            plain = [w for w in new if w and " " not in w and not w[0].isspace()]
            cache.update(zip(plain, self.words(plain), strict=True))
        rest = [w for w in new if w not in cache]
        cache.update(zip(rest, self.whole([prefix + w for w in rest]), strict=True))
        return [w for w in new if len(w) > MAX_CACHED_LENGTH]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Raw little-endian ids of each text."""
        out: dict[int, bytes] = {}
        cut: dict[int, tuple[str, list[str]]] = {}
        for i, t in enumerate(texts):
            if not self.by_word or any(s in t for s in self.special):
                out[i] = self.whole([t])[0]
            elif SPACE_RUN.search(t):
                head, *rest = INNER_CUT.split(t)
                cut[i] = head, [w[1:] for w in rest]
            else:
                head, *rest = t.split(" ")
                cut[i] = head, rest
        long_first = self._learn(self.first, {head for head, _ in cut.values()}, "")
        inner = set(chain.from_iterable(rest for _, rest in cut.values()))
        long_inner = self._learn(self.after_space, inner, " ")
        for i, (head, rest) in cut.items():
            out[i] = self.first[head] + b"".join(map(self.after_space.__getitem__, rest))
        for cache, words in ((self.first, long_first), (self.after_space, long_inner)):
            for w in words:
                del cache[w]
        return [out[i] for i in range(len(texts))]


def _files(folder: str):
    from pyarrow.fs import FileSystem

    if "://" not in folder and folder.startswith("file:"):
        folder = folder[len("file:") :]
    return FileSystem.from_uri(folder)


def _dump_index(keys: list[int | None], lengths: list[int], dtype: np.dtype) -> bytes:
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i8")
    valid = np.array([k is not None for k in keys], np.uint8)
    plain = np.array([k or 0 for k in keys], "<i8")
    rows = np.flatnonzero(valid)
    distinct, at, run = np.unique(plain[rows], return_index=True, return_counts=True)
    table = PerfectHash.build(distinct.view("<u8"))
    number = table.numbers(distinct.view("<u8"))
    prints, first, runs = (np.zeros(len(distinct), "<u4") for _ in range(3))
    prints[number] = fingerprints(distinct.view("<u8"))
    first[number], runs[number] = rows[at], run
    arrays = {
        "starts": starts, "keys": plain, "valid": valid, "bits": table.bits,
        "fingerprints": prints, "first": first, "runs": runs,
    }
    header = json.dumps(
        {
            "ids": dtype.str,
            "sizes": table.sizes,
            "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()],
        }
    ).encode()
    return b"".join(
        [MAGIC, len(header).to_bytes(8, "little"), header, *(v.tobytes() for v in arrays.values())]
    )


class Shard:
    """Keyed access to the documents of one shard."""

    def __init__(self, fs, path: str):
        with fs.open_input_stream(f"{path}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{path}.idx is no token index")
        at = 16 + int.from_bytes(raw[8:16], "little")
        header = json.loads(raw[16:at])
        for name, kind, n in header["arrays"]:
            setattr(self, name, np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.dtype = np.dtype(header["ids"])
        self.table = PerfectHash(self.bits, header["sizes"])
        self.payload = fs.open_input_file(f"{path}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents under each key; (-1, 0) where there is none."""
        raw = keys.astype("<i8").view("<u8")
        number = self.table.numbers(raw)
        hit = number >= 0
        hit[hit] = self.fingerprints[number[hit]] == fingerprints(raw[hit])
        # A fingerprint can be that of another key by chance: the stored key decides.
        hit[hit] = self.keys[self.first[number[hit]]] == keys[hit]
        first, runs = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[hit], runs[hit] = self.first[number[hit]], self.runs[number[hit]]
        return first, runs

    def ids(self, doc: int) -> np.ndarray:
        start, end = int(self.starts[doc]), int(self.starts[doc + 1])
        width = self.dtype.itemsize
        return np.frombuffer(self.payload.read_at((end - start) * width, start * width), self.dtype)

    def documents(self) -> Iterator[int]:
        """Numbers of all documents in order: by key through the index, those without a key last."""
        at = np.flatnonzero(self.valid)
        first, runs = self.find(np.unique(self.keys[at]))
        within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        yield from (np.repeat(first, runs) + within).tolist()
        yield from np.flatnonzero(self.valid == 0).tolist()


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = 2,
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write the ids of all documents below ``folder`` (a new one) and return the manifest.

    NULL ids come first, repeated ids follow one another.  A NULL or empty text is a document
    of just the end id.  Columns besides the two named ones are ignored.  An empty table gives
    a manifest without rows.
    """
    fs, root = _files(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        encoder = ByteEncoder.of(tokenizer)
        width = encoder.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        path, own = f"{root}/shard-{shard:05d}", f"{root}/.{shard:05d}-{uuid.uuid4().hex}"
        keys: list[int | None] = []
        lengths: list[int] = []
        with fs.open_output_stream(f"{own}.ids") as out:
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                keys += batch.column("row_id").to_pylist()
                for i in range(0, len(texts), 512):
                    for raw in encoder.encode(texts[i : i + 512]):
                        out.write(raw + end)
                        lengths.append((len(raw) + len(end)) // width)
        if not keys:
            fs.delete_file(f"{own}.ids")
            return
        with fs.open_output_stream(f"{own}.idx") as out:
            out.write(_dump_index(keys, lengths, encoder.dtype))
        for kind in ("ids", "idx"):
            fs.move(f"{own}.{kind}", f"{path}.{kind}")
        known = [k for k in keys if k is not None]
        row = [shard, len(keys), sum(lengths), min(known, default=None), max(known, default=None), path]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.string() if i == 5 else pa.int64()) for i, v in enumerate(row)],
            ["shard", "n_docs", "n_tokens", "min_key", "max_key", "path"],
        )

    # The hash keeps rows of one id apart where an id is very frequent.
    tie = F.xxhash64("text")
    dealt = (
        docs.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
        .repartitionByRange("row_id", tie)
        .sortWithinPartitions("row_id", tie)
    )
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def placed_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``base``, the ids before each shard: a running sum over shards."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """All documents from the files: (row_id, start, n_tokens, ids_crc32[, ids]).

    Each task opens one shard, looks its keys up in the index and reads the ids at the places
    found.  ``start`` counts the ids of all documents before; the checksum is that of the ids
    as little-endian unsigned 32-bit integers.
    """
    schema = "row_id long, start long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema += ", ids array<int>"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _files(folder)
        for frame in frames:
            for row in frame.itertuples():
                shard, rows = Shard(fs, row.path), []
                for doc in shard.documents():
                    ids = shard.ids(doc)
                    key = int(shard.keys[doc]) if shard.valid[doc] else None
                    crc = zlib.crc32(ids.astype("<u4"))
                    rows.append((key, int(row.base + shard.starts[doc]), len(ids), crc))
                    if with_ids:
                        rows[-1] += (ids.astype(np.int32),)
                    if len(rows) >= 2_000:
                        yield _frame(rows, with_ids)
                        rows = []
                yield _frame(rows, with_ids)

    shards = placed_shards(spark, folder)
    return shards.repartition(max(1, shards.count())).mapInPandas(read, schema)


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    names = ["row_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return pd.DataFrame(rows, columns=names).astype({"row_id": "Int64"})


def lookup(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of given documents: (key, start, ids), one row per stored document of each key.

    Keys go to the shards whose range holds them; the bounds are one pair per shard.  Keys
    that are not stored, and NULL keys, give no row; a repeated key is answered each time.
    """
    bounds = placed_shards(spark, folder).where("min_key IS NOT NULL").orderBy("shard").toPandas()
    low, high = bounds["min_key"].to_numpy(), bounds["max_key"].to_numpy()
    paths, bases = bounds["path"].tolist(), bounds["base"].tolist()

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            k = frame["key"].to_numpy()
            start, end = np.searchsorted(high, k, "left"), np.searchsorted(low, k, "right")
            n = np.maximum(end - start, 0)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"key": np.repeat(k, n), "shard": np.repeat(start, n) + inner})

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _files(folder)
        opened, shard = None, None
        for frame in frames:
            for number, part in frame.groupby("shard"):
                if number != opened:
                    opened, shard = number, Shard(fs, paths[number])
                first, runs = shard.find(part["key"].to_numpy())
                rows = [
                    (int(shard.keys[d]), int(bases[number] + shard.starts[d]), shard.ids(d))
                    for f, r in zip(first.tolist(), runs.tolist(), strict=True)
                    for d in range(f, f + r)
                ]
                yield pd.DataFrame(rows, columns=["key", "start", "ids"])

    wanted = keys.select(F.col(key).cast("long").alias("key")).where("key IS NOT NULL")
    return (
        wanted.mapInPandas(route, "key long, shard long")
        .repartition("shard", F.pmod(F.xxhash64("key"), F.lit(16)))
        .sortWithinPartitions("shard")
        .mapInPandas(fetch, "key long, start long, ids array<int>")
    )
