"""Masked pseudo-likelihood of texts under a bidirectional window network.

Tokens are the bytes of the UTF-8 text.  The network predicts each token from the ``RADIUS``
tokens on either side of it: one embedding per place, a hidden layer, a softmax over all bytes.
A text's score is the sum of the log-probabilities of its tokens, each with the others given.

The corpus is gathered as counts of all windows (token and neighbours) of all texts.  Training
runs in rounds over that table: every partition takes gradient steps on windows drawn by their
counts, starting from the common weights, and the weights are averaged by the counts that the
partitions stand for.  So training sees the whole corpus, however large, and the driver only
sees weights of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

RADIUS = 2
EMBEDDING = 8
HIDDEN = 64
BYTES = 256
ROUNDS = 4
STEPS = 250
BATCH = 512
WINDOWS_PER_SHARE = 100_000  # different windows that one set of gradient steps stands for
MAX_KNOWN = 2_000_000  # windows whose log-probability a worker remembers
AT_A_TIME = 4096
CHUNK = 2_000_000  # bytes whose windows are looked at together


def codes(texts: list[str | None], radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window codes, text numbers) of all tokens, a bounded number at a time.

    A code holds 2 * radius + 1 bytes, the first in the highest place.  Beyond the ends of a
    text there are zero bytes.
    """
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    pad = bytes(radius)
    flat = np.frombuffer(b"".join([pad, *[r + pad for r in raw], pad]), np.uint8)
    owner = np.repeat(np.arange(len(raw)), sizes + radius)
    starts = np.cumsum(sizes + radius) - (sizes + radius)
    inner = np.arange(len(owner)) - np.repeat(starts, sizes + radius)
    real = inner < np.repeat(sizes, sizes + radius)
    for i in range(0, len(owner), CHUNK):
        part = flat[i : i + CHUNK + 2 * radius].astype(np.int64)
        n = min(CHUNK, len(owner) - i)
        code = np.zeros(n, np.int64)
        for j in range(2 * radius + 1):
            code = code << 8 | part[j : j + n]
        keep = real[i : i + n]
        yield code[keep], owner[i : i + n][keep]


@dataclass
class WindowNetwork:
    weights: dict[str, np.ndarray]
    radius: int = RADIUS

    @classmethod
    def new(cls, seed: int = 0, radius: int = RADIUS) -> WindowNetwork:
        rng = np.random.default_rng(seed)
        wide = 2 * radius * EMBEDDING
        return cls(
            {
                "embed": rng.standard_normal((BYTES, EMBEDDING)).astype(np.float32),
                "in": (rng.standard_normal((wide, HIDDEN)) / np.sqrt(wide)).astype(np.float32),
                "in_bias": np.zeros(HIDDEN, np.float32),
                "out": (rng.standard_normal((HIDDEN, BYTES)) / np.sqrt(HIDDEN)).astype(np.float32),
                "out_bias": np.zeros(BYTES, np.float32),
            },
            radius,
        )

    def split(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours (left to right) and the token between them."""
        shifts = 8 * np.arange(2 * self.radius, -1, -1)
        all_bytes = code[:, None] >> shifts & 255
        return np.delete(all_bytes, self.radius, axis=1), all_bytes[:, self.radius]

    def _forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        x = w["embed"][around].reshape(len(around), -1)
        h = np.tanh(x @ w["in"] + w["in_bias"])
        z = h @ w["out"] + w["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return x, h, z

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Of the middle token of each window."""
        out = np.empty(len(code))
        for i in range(0, len(code), AT_A_TIME):
            around, token = self.split(code[i : i + AT_A_TIME])
            out[i : i + len(token)] = self._forward(around)[2][np.arange(len(token)), token]
        return out

    def train(self, code: np.ndarray, count: np.ndarray, steps: int, seed: int) -> None:
        """Adam steps on windows drawn by ``count``."""
        rng = np.random.default_rng(seed)
        reach = np.cumsum(count)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            drawn = code[np.searchsorted(reach, rng.integers(0, reach[-1], BATCH), "right")]
            around, token = self.split(drawn)
            x, h, z = self._forward(around)
            d = np.exp(z)
            d[np.arange(BATCH), token] -= 1
            d /= BATCH
            back = (d @ self.weights["out"].T) * (1 - h * h)
            g = {"out": h.T @ d, "out_bias": d.sum(axis=0), "in": x.T @ back, "in_bias": back.sum(axis=0)}
            g["embed"] = np.zeros_like(self.weights["embed"])
            np.add.at(g["embed"], around, (back @ self.weights["in"].T).reshape(*around.shape, EMBEDDING))
            rate = 5e-3 * (1 - step / (steps + 1))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                a, b = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                self.weights[k] -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)


def window_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): how often each window occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for group in _groups(texts):
                for code, _ in codes(group):
                    found, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found), pa.array(n.astype(np.int64))], ["code", "n"]
                    )

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about CHUNK characters; a longer text is one run."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def fit(
    docs: DataFrame, text: str = "text", rounds: int = ROUNDS, steps: int = STEPS
) -> WindowNetwork:
    """Train on the windows of all texts; an empty corpus leaves the initial weights."""
    counts = materialize(window_counts(docs, text))
    shares = max(1, -(-counts.count() // WINDOWS_PER_SHARE))
    net = WindowNetwork.new()
    names = list(net.weights)
    for turn in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], net=net, turn=turn) -> Iterator[pa.RecordBatch]:
            got = [(b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches]
            code = np.concatenate([c for c, _ in got]) if got else np.zeros(0, np.int64)
            if not len(code):
                return
            count = np.concatenate([n for _, n in got])
            order = np.argsort(code)  # the same draws in every run
            own = WindowNetwork({k: v.copy() for k, v in net.weights.items()}, net.radius)
            seed = 1_000 * turn + TaskContext.get().partitionId()
            own.train(code[order], count[order], steps, seed)
            mass = float(count.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([mass]), *[pa.array([own.weights[k].tobytes()], pa.binary()) for k in names]],
                ["mass", *names],
            )

        schema = "mass double, " + ", ".join(f"`{k}` binary" for k in names)
        # Windows are dealt out evenly, so each share is a picture of the corpus; the work is in
        # proportion to the number of different windows, however many partitions they came in.
        learned = counts.repartition(shares).mapInArrow(learn, schema)
        total, sums = 0.0, {k: np.zeros(v.shape) for k, v in net.weights.items()}
        for row in learned.toLocalIterator():  # one set of weights at a time
            total += row["mass"]
            for k in names:
                sums[k] += row["mass"] * np.frombuffer(row[k], np.float32).reshape(sums[k].shape)
        if total:
            net = WindowNetwork({k: (v / total).astype(np.float32) for k, v in sums.items()}, net.radius)
    return net


class _Known:
    """Log-probabilities of the windows that a worker has met, by code."""

    key: bytes = b""
    codes = np.zeros(0, np.int64)
    values = np.zeros(0)

    @classmethod
    def look_up(cls, net: WindowNetwork, code: np.ndarray) -> np.ndarray:
        key = net.weights["out"].tobytes()
        if cls.key != key or len(cls.codes) > MAX_KNOWN:
            cls.key, cls.codes, cls.values = key, np.zeros(0, np.int64), np.zeros(0)
        wanted, back = np.unique(code, return_inverse=True)
        new = wanted[~np.isin(wanted, cls.codes, assume_unique=True)]
        if len(new):
            merged = np.concatenate([cls.codes, new])
            values = np.concatenate([cls.values, net.log_probabilities(new)])
            order = np.argsort(merged, kind="stable")
            cls.codes, cls.values = merged[order], values[order]
        return cls.values[np.searchsorted(cls.codes, wanted)][back]


def score(docs: DataFrame, net: WindowNetwork, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``log_prob`` (their summed log-probabilities) and ``score`` (the mean).

    NULL and empty texts have no tokens, log-probability 0 and score 0.  All columns of
    ``docs`` are kept, but for earlier ones of these names.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        sums, sizes = [], []
        for group in _groups(texts.tolist()):
            total, n = np.zeros(len(group)), np.zeros(len(group), np.int64)
            for code, owner in codes(group):
                total += np.bincount(owner, _Known.look_up(net, code), len(group))
                n += np.bincount(owner, minlength=len(group))
            sums += total.tolist()
            sizes += n.tolist()
        return pd.DataFrame({"n": np.array(sizes, np.int64), "s": np.array(sums, float)})

    run = F.pandas_udf(run, "n long, s double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return (
        docs.withColumn("_lm", run(F.col(text)))
        .withColumn("n_tokens", F.col("_lm.n"))
        .withColumn("log_prob", F.col("_lm.s"))
        .withColumn("score", F.coalesce(mean, F.lit(0.0)))
        .drop("_lm")
    )
