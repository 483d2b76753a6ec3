"""Language identification by a byte convolutional network.

The UTF-8 bytes of a text are cut into windows of fixed length, the last one filled with blanks.
In each window, filters of several widths run over byte embeddings; the largest response of each
filter goes into a softmax over the languages.  The probabilities of a text are the means over
all its windows.  The network is trained in numpy on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .common import held_out

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 6
MAX_TEXTS = 400  # training texts per language
MAX_WINDOWS = 16  # training windows per text
SHORT = (8, 16, 32, 64)  # bytes left of windows cut short for training
EPOCHS = 6
BATCH = 64
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
AT_A_TIME = 1024  # windows
MAX_BROADCAST = 100_000  # sampled rows (an id and a language) sent to all executors


def windows(texts: list[str | None], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows x size) bytes, and the number of windows of each text (at least one)."""
    parts, counts = [], []
    for t in texts:
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // size))
        parts.append(raw.ljust(n * size, b" "))
        counts.append(n)
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, size), np.array(counts)


@dataclass
class ByteNetwork:
    """Weights: an embedding, a filter bank and a bias per width, and the softmax layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], seed: int = 0) -> ByteNetwork:
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        weights = {"embed": draw(256, EMBEDDING) * 8}
        for w in WIDTHS:
            weights[f"filter{w}"] = draw(w * EMBEDDING, FILTERS)
            weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        weights["out"] = draw(FILTERS * len(WIDTHS), len(languages))
        weights["out_bias"] = np.zeros(len(languages), np.float32)
        return cls(languages, weights)

    def _responses(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Embedded stretches of ``width`` bytes, and the response of each filter to them."""
        e = self.weights["embed"][x]
        n = x.shape[1] - width + 1
        stretch = np.concatenate([e[:, i : i + n] for i in range(width)], axis=2)
        return stretch, stretch @ self.weights[f"filter{width}"] + self.weights[f"bias{width}"]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax per window."""
        out = []
        for i in range(0, len(x), AT_A_TIME):
            part = x[i : i + AT_A_TIME]
            pooled = [np.maximum(self._responses(part, w)[1].max(axis=1), 0) for w in WIDTHS]
            z = np.hstack(pooled) @ self.weights["out"] + self.weights["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of one batch."""
        seen, pooled = [], []
        rows = np.arange(len(x))
        for w in WIDTHS:
            stretch, z = self._responses(x, w)
            at = z.argmax(axis=1)  # (windows, filters)
            top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :]
            seen.append((at, stretch[rows[:, None], at], top > 0))
            pooled.append(np.maximum(top, 0))
        h = np.hstack(pooled)
        z = h @ self.weights["out"] + self.weights["out_bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, y] -= 1
        p /= len(x)
        out = {"out": h.T @ p, "out_bias": p.sum(axis=0), "embed": np.zeros_like(self.weights["embed"])}
        back = p @ self.weights["out"].T
        for i, w in enumerate(WIDTHS):
            at, stretch, on = seen[i]
            d = back[:, i * FILTERS : (i + 1) * FILTERS] * on
            out[f"filter{w}"] = np.einsum("bfk,bf->kf", stretch, d)
            out[f"bias{w}"] = d.sum(axis=0)
            spread = d[:, :, None] * self.weights[f"filter{w}"].T[None]
            spread = spread.reshape(len(x), FILTERS, w, EMBEDDING)
            places = at[:, :, None] + np.arange(w)
            np.add.at(out["embed"], x[rows[:, None, None], places], spread)
        return out


def train(x: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 0) -> ByteNetwork:
    """Fit on windows with their languages by Adam steps."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    net = ByteNetwork.new(languages, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step, steps = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            batch = order[i : i + BATCH]
            step += 1
            rate = 4e-3 * (1 - step / (steps + 1))
            for k, g in net.gradients(x[batch], y[batch]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                a = first[k] / (1 - 0.9**step)
                b = second[k] / (1 - 0.999**step)
                net.weights[k] -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def fit(
    docs: DataFrame, max_texts: int = MAX_TEXTS, max_windows: int = MAX_WINDOWS
) -> ByteNetwork | None:
    """Learn from the texts with a language whose fold is not held out.

    Per language the ``max_texts`` texts that come first in a hash order of the ids, and up to
    ``max_windows`` windows spread evenly over each of them.  NULL languages and ids and texts
    without letters are not learned from.  Without any language there is no network.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, langs = [], []
            for text, lang in zip(
                batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True
            ):
                if LETTER.search(text or ""):
                    x = windows([text])[0]
                    pick = np.unique(np.linspace(0, len(x) - 1, max_windows).astype(int))
                    raw += [x[i].tobytes() for i in pick]
                    # Short texts are mostly fill: the network learns from such windows too.
                    short = [SHORT[k % len(SHORT)] for k in range(len(pick))]
                    raw += [x[i].tobytes()[:n].ljust(WINDOW) for i, n in zip(pick, short, strict=True)]
                    langs += [lang] * (2 * len(pick))
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw, pa.binary()), pa.array(langs, pa.string())], ["window", "lang"]
            )

    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(
        ~held_out(F.col("doc_id"))
    )
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("language")), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("n", F.row_number().over(order))
    chosen = materialize(ids.where(F.col("n") <= max_texts).select("doc_id", "lang"))
    if chosen.count() <= MAX_BROADCAST:
        chosen = F.broadcast(chosen)
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "lang")
    got = texts.mapInArrow(cut, "window binary, lang string").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "window"])  # the same network in every run
    x = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(len(got), WINDOW)
    return train(x, got["lang"].tolist())


def predict(docs: DataFrame, net: ByteNetwork | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the mean probability of that language.

    Texts that are NULL or have no letter are ``und`` with score 0, as are all texts if nothing
    was learned.  All columns of ``docs`` are kept, but for earlier ones of these two names.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang": [UNDETERMINED] * len(texts), "score": 0.0})
        if net is None:
            return out
        told = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        langs, scores = out["lang"].tolist(), out["score"].tolist()
        # Groups of bounded size; a very long text is a group of its own.
        group, size = [], 0
        for i in [*told, None]:
            if i is not None:
                group.append(i)
                size += len(texts.iloc[i])
            if group and (i is None or size > 1 << 20):
                x, counts = windows([texts.iloc[j] for j in group])
                p = np.add.reduceat(net.probabilities(x).astype(float), np.cumsum(counts) - counts)
                p /= counts[:, None]
                for j, best, row in zip(group, p.argmax(axis=1), p, strict=True):
                    langs[j], scores[j] = net.languages[best], float(min(1.0, row[best]))
                group, size = [], 0
        return pd.DataFrame({"lang": langs, "score": scores})

    run = F.pandas_udf(run, "lang string, score double")
    told = docs.withColumn("_told", run(F.col(text)))
    return (
        told.withColumn("lang_pred", F.col("_told.lang"))
        .withColumn("score", F.col("_told.score"))
        .drop("_told")
    )


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    return predict(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
