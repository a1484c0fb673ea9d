"""A quality classifier from positive and unlabelled texts.

Trusted positives (label 1) and unlabelled web text train a linear model over binned text measures (``style``) by the
non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss, so the score is the chance of label 1. When the second term turns negative, its slope is turned
around, which keeps the model from fitting negatives that it has not seen. The class prior is estimated on the
labelled training rows, as the share of positives.

The fit uses a bounded sample: at most about ``POSITIVES`` positives and ``UNLABELLED`` texts, chosen by a hash of the
id. Counts for the prior cover all training labels. Every document is scored over its whole text.

Defined results: null and empty texts are scored alike; repeated rows each get a row; a null id is never held out and
never a training row; without any positive label all scores are the prior of one half; an empty table gives no rows;
extra columns are ignored, and kept by ``drop_rejected``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrewatch.llm.stages import keep_rows
from pyrewatch.llm.style import MEASURES, WIDTH, sigmoid, style_of

POSITIVES = 15_000
UNLABELLED = 30_000
THRESHOLD = 0.3
HELD_OUT_OF = 5


def held_out(of: int = HELD_OUT_OF, rest: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``rest``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % of == rest, F.lit(False))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, style: np.ndarray) -> np.ndarray:
        return sigmoid(self.weights[style].sum(axis=1) + self.bias)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.1,
        decay: float = 2e-4, batch: int = 4096, seed: int = 5) -> Model:
    """Minimise the non-negative risk with Adam over mixed batches."""
    prior = min(max(prior, 0.01), 0.99)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), 0.0)
    rng = np.random.default_rng(seed)
    w = np.zeros(WIDTH + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)

    def slope(style: np.ndarray, by_score: np.ndarray) -> np.ndarray:
        out = np.empty(WIDTH + 1)
        out[:-1] = np.bincount(style.ravel(), weights=np.repeat(by_score, style.shape[1]), minlength=WIDTH)
        out[-1] = by_score.sum()
        return out / len(style)

    average = np.zeros_like(w)
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(batch, len(positive)))]
        u = unlabelled[rng.integers(0, len(unlabelled), min(batch, len(unlabelled)))]
        score_p, score_u = w[p].sum(axis=1) + w[-1], w[u].sum(axis=1) + w[-1]
        # The logistic loss of a negative is log(1 + exp(score)).
        negative = np.logaddexp(0, score_u).mean() - prior * np.logaddexp(0, score_p).mean()
        turn = slope(u, sigmoid(score_u)) - prior * slope(p, sigmoid(score_p))
        total = (prior * slope(p, sigmoid(score_p) - 1) + turn if negative >= 0 else -turn) + decay * w
        mean, square = 0.9 * mean + 0.1 * total, 0.999 * square + 0.001 * total ** 2
        w = w - rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        if step > steps // 2:
            average += w / (steps - steps // 2)
    return Model(average[:-1], float(average[-1]))


def _style_batches(batches):
    for batch in batches:
        style = style_of(batch.column(0)).astype("<u2")
        yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in style], pa.binary())], ["style"])


def _sample(rows: DataFrame, total: int, wanted: int, salt: int) -> np.ndarray:
    """Measures of about ``wanted`` rows, chosen by hash; all if there are fewer."""
    if total > wanted:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * wanted / total))
    blobs = rows.select("text").mapInArrow(_style_batches, "style binary").toArrow().column("style").to_pylist()
    return np.frombuffer(b"".join(sorted(blobs)), "<u2").reshape(-1, len(MEASURES)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels of rows that are not held out and on any text."""
    known = (labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
                   .filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
                   .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counts = known.agg(F.count(F.lit(1)), F.sum(F.expr("int(quality = 1)"))).first()
    if not counts[0] or not counts[1]:
        return Model(np.zeros(WIDTH), 0.0)
    positive = _sample(texts.join(known.filter("quality = 1"), "doc_id", "left_semi"), counts[1], POSITIVES, 1)
    unlabelled = _sample(texts, docs.count(), UNLABELLED, 2)
    return fit(positive, unlabelled, counts[1] / counts[0])


def _score_batches(model: Model):
    def run(batches):
        for batch in batches:
            scores = model.score(style_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])
    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _score_batches(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; rows pass through whole."""
    model = train(docs, labels)
    return keep_rows(docs, "text", lambda texts: pa.array(model.score(style_of(texts)) >= threshold))
