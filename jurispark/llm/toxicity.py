"""Toxicity by weak supervision.

Voters are words and word beginnings that labelled toxic texts use far more often than labelled
clean ones, and patterns of writing.  Each votes "toxic" where it occurs; voters for "clean" fire
where none of the others does.  A generative model of a hidden label explains the votes: EM finds
how often each voter fires under either label, and what the votes still have in common once the
label is known gives their correlations, by which correlated voters are discounted.  The
given labels take part as one more voter.  The posterior labels train a linear classifier, which scores every text.

Training sees at most ``MAX_LABELLED`` labelled rows (a hash sample, in expectation); the votes
of these rows, small integers, are all that comes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .common import WORD, held_out

MAX_LABELLED = 50_000
MAX_VOTERS = 400
MIN_TOXIC_TEXTS = 5  # texts a word must occur in to become a voter
MIN_LIFT = 25.0  # times more frequent in toxic texts
MIN_EVIDENCE = 40.0  # log-likelihood ratio: chance among a hundred million terms
PREFIX = 5
MIN_CORRELATION = 0.3
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
EXCLAIM = re.compile(r"!{2,}|[?!]{3,}")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
PATTERNS = 3


def terms(text: str | None) -> list[str]:
    """Words in lower case, and the beginnings (with a star) of those longer than that."""
    words = LETTERS.findall((text or "").lower())
    return words + [w[:PREFIX] + "*" for w in words if len(w) > PREFIX]


def pattern_counts(text: str | None) -> list[int]:
    text = text or ""
    return [len(p.findall(text)) for p in (SHOUT, EXCLAIM, STRETCHED)]


def without_copies(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text, label) without exact copies of rows with a smaller id and the
    same label: the same words in lower case.

    Copies would otherwise count as evidence of their own for every word in them.  Texts without
    words all stay.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    signed = texts.withColumn("_sig", F.md5(F.array_join(words, " ").cast("binary")))
    signed = materialize(signed.withColumn("_bare", F.size(words) == 0))
    least = signed.where("NOT _bare").groupBy("_sig", "label").agg(F.min("doc_id").alias("doc_id"))
    # The id is among the keys, so that a large group of copies is no hot key.
    first = signed.where("NOT _bare").join(least, ["doc_id", "_sig", "label"], "left_semi")
    return first.unionByName(signed.where("_bare")).select(*texts.columns)


def label_counts(texts: DataFrame) -> tuple[int, int]:
    """Texts with label 1 and with label 0."""
    sizes = texts.agg(
        F.sum("label").alias("toxic"), F.sum(F.lit(1) - F.col("label")).alias("clean")
    ).first()
    return sizes["toxic"] or 0, sizes["clean"] or 0


def find_terms(texts: DataFrame, limit: int = MAX_VOTERS) -> list[str]:
    """Terms that speak for label 1, strongest first: at most ``limit``.

    ``texts`` is (text, label).  The score is the log-likelihood ratio of "occurs in the text"
    against the label.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column("text").to_pylist()]
            labels = np.repeat(batch.column("label").to_numpy(), [len(f) for f in found])
            flat = pa.array([t for f in found for t in f], pa.string())
            yield pa.RecordBatch.from_arrays([flat, pa.array(labels)], ["term", "label"])

    toxic, clean = label_counts(texts)
    if not toxic or not clean:
        return []
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    rate = (a + c) / F.lit(float(toxic + clean))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = (
        part(a, rate * toxic)
        + part(c, rate * clean)
        + part(F.lit(float(toxic)) - a, (1 - rate) * toxic)
        + part(F.lit(float(clean)) - c, (1 - rate) * clean)
    )
    lift = ((a + 0.1) / float(toxic)) / ((c + 0.1) / float(clean))
    counts = (
        texts.mapInArrow(split, "term string, label int")
        .groupBy("term")
        .agg(F.sum("label").alias("a"), F.sum(F.lit(1) - F.col("label")).alias("c"))
        .where((F.col("a") >= MIN_TOXIC_TEXTS) & (lift >= MIN_LIFT) & (2 * ratio >= MIN_EVIDENCE))
    )
    best = counts.select("term", ratio.alias("s")).orderBy(F.desc("s"), "term").limit(limit)
    return [r["term"] for r in best.collect()]


@dataclass
class Voters:
    """Counts of the voters in a text, as the columns of a matrix."""

    terms: list[str]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: occurrences of each term and pattern, then the number of words."""
        number = {t: i for i, t in enumerate(self.terms)}
        out = np.zeros((len(texts), len(self.terms) + PATTERNS + 1), np.int32)
        for row, text in zip(out, texts, strict=True):
            found = LETTERS.findall((text or "").lower())
            row[-1] = len(found)
            row[-1 - PATTERNS : -1] = pattern_counts(text)
            for w in found:
                i = number.get(w)
                if i is not None:
                    row[i] += 1
                if len(w) > PREFIX:
                    i = number.get(w[:PREFIX] + "*")
                    if i is not None:
                        row[i] += 1
        return out

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """0/1 per voter: terms, patterns, two or more terms, and two that speak for "clean"."""
        hits = counts[:, :-1] > 0
        n = hits[:, : len(self.terms)].sum(axis=1, keepdims=True)
        long = counts[:, -1:] >= 100
        return np.hstack([hits, n >= 2, n == 0, (n == 0) & long]).astype(np.float64)

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Inputs of the linear classifier: damped counts, any and how many terms, their share, one."""
        n = counts[:, : len(self.terms)]
        words = np.maximum(counts[:, -1:], 1)
        return np.hstack(
            [
                np.log1p(counts[:, :-1]),
                (n > 0).any(axis=1, keepdims=True),
                np.log1p((n > 0).sum(axis=1, keepdims=True)),
                np.log1p(100 * n.sum(axis=1, keepdims=True) / words),
                np.ones((len(counts), 1)),
            ]
        )


@dataclass
class LabelModel:
    """Hidden-label model of 0/1 votes with rates per label and discounts for correlation."""

    prior: float
    rates: np.ndarray  # (2, voters): how often a voter fires under label 0 and 1
    correlations: np.ndarray  # (voters, voters): of the votes, the label known
    discount: np.ndarray

    @property
    def accuracies(self) -> np.ndarray:
        """Probability that the label is what a firing voter speaks for."""
        on = self.rates * np.array([[1 - self.prior], [self.prior]])
        return on.max(axis=0) / on.sum(axis=0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.rates), np.log1p(-self.rates)
        odds = np.log(self.prior / (1 - self.prior)) + (
            votes @ ((log[0][1] - log[0][0]) * self.discount)
            + (1 - votes) @ ((log[1][1] - log[1][0]) * self.discount)
        )
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 2, steps: int = 25) -> LabelModel:
    """EM from the posterior ``start``; after each round the correlations of the residuals."""
    q, k = start.clip(0.01, 0.99), votes.shape[1]
    discount, correlations = np.ones(k), np.eye(k)
    for _ in range(rounds):
        for _ in range(steps):
            weights = np.stack([1 - q, q])
            mass = weights.sum(axis=1, keepdims=True)
            rates = (weights @ votes + 0.05) / (mass + 0.1)
            prior = float(np.clip(q.mean(), 0.001, 0.999))
            model = LabelModel(prior, rates, correlations, discount)
            q = model.posterior(votes)
        rest = votes - q[:, None] * rates[1] - (1 - q)[:, None] * rates[0]
        spread = np.sqrt(np.maximum((rest**2).mean(axis=0), 1e-9))
        correlations = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
        positive = np.maximum(correlations - np.eye(k), 0)
        # Voters that merely meet more often in long texts are no copies of one another.
        positive[positive < max(MIN_CORRELATION, 4 / np.sqrt(len(rest)))] = 0
        discount = 1 / (1 + positive.sum(axis=1))
    return LabelModel(prior, rates, correlations, discount)


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the constant is not shrunk."""
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + shrink * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel | None
    weights: np.ndarray | None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:  # nothing could be learned
            return np.zeros(len(texts))
        x = self.voters.features(self.voters.counts(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    max_voters: int = MAX_VOTERS,
) -> ToxicityModel:
    """Learn from documents with a label whose fold is not held out.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0/1).  Rows with a NULL label or
    id are not learned from; of repeated labels of a document the largest counts.  Without both
    labels the model scores 0 throughout; without any telling term the patterns vote alone.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    known_rows = known.count()
    keep = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    sample = known.where(keep < int(np.ceil(1e6 * min(1.0, max_labelled / max(known_rows, 1)))))
    # The sample is bounded by a parameter, so sending it to all executors is safe and spares
    # a shuffle of all texts.
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    texts = materialize(without_copies(rows).select("text", "label"))
    voters = Voters(find_terms(texts, max_voters))
    if not all(label_counts(texts)):
        return ToxicityModel(voters, None, None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = voters.counts(batch.column("text").to_pylist())
            packed = pa.array([r.astype("<i4").tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column("label")], ["counts", "label"])

    got = texts.mapInArrow(count, "counts binary, label int").toPandas()
    got = got.sort_values(["counts", "label"])  # the same sums in every run
    counts = np.frombuffer(b"".join(got["counts"]), "<i4").reshape(len(got), -1)
    # The annotator is one more voter of unknown accuracy: it keeps the hidden label from
    # becoming another property of the texts, and some of its votes are outvoted.
    given = got["label"].to_numpy(np.float64)
    votes = np.hstack([voters.votes(counts), given[:, None]])
    model = fit_label_model(votes, np.where(given == 1, 0.9, 0.1))
    weights = fit_linear(voters.features(counts), model.posterior(votes))
    return ToxicityModel(voters, model, weights)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1, higher: toxic) and ``predicted`` (1 from ``threshold`` on) to each row.

    NULL and empty texts are scored like a text without words.  All columns of ``docs`` are
    kept, but for earlier ones of these two names.
    """

    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    scored = F.pandas_udf(scored, "double")
    return docs.withColumn("score", scored(F.col("text"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
