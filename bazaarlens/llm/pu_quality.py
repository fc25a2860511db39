"""Text quality by positive-unlabelled learning.

Trusted positives and unlabelled text train a small network that minimises the non-negative unbiased risk
    prior * loss(positives as good) + max(0, loss(unlabelled as bad) - prior * loss(positives as bad)),
with the sigmoid loss. The prior, the share of good texts among all, is estimated from the positives and the unlabelled
texts alone: of those that score above a threshold the good ones are as many as the prior times the share of positives
above it, so the least ratio of both shares over thresholds bounds the prior from above, and is near it where no bad text
scores as high. Both samples are bounded (`SAMPLE` rows each, those with the smallest hashes), so training is a small job on the driver at any size of
the data; features and scores of all texts are computed where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import portions, raw
from .storage import id_and_text

#: Rows of each sample at most.
SAMPLE = 6000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 16, 60, 512, 0.01, 11
PRIOR_RANGE = (0.05, 0.95)
#: Shares of the positives that the thresholds keep from which the prior is read: enough of them for a ratio.
KEPT = np.linspace(0.3, 0.95, 27)
#: Classes of bytes whose shares are features: lower, upper, digits, marks of sentences, other marks, space, line feed, rest.
CLASSES = np.full(256, 7, dtype=np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-")):
    CLASSES[list(_bytes)] = _k
CLASSES[[b for b in range(33, 127) if CLASSES[b] == 7]] = 4
CLASSES[32], CLASSES[10] = 5, 6
N_FEATURES = 8 + 128 + 9


def features(text: bytes) -> np.ndarray:
    """Of a whole text in UTF-8: shares of byte classes and bytes, lengths, and how much of it repeats."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return out
    counts = np.bincount(data, minlength=256)
    out[:8] = np.bincount(CLASSES, weights=counts, minlength=8) / len(data)
    out[8:136] = np.sqrt(counts[:128] / len(data))
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x]
    pairs = max(1, len(words) - 1)
    out[136:] = (
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / pairs,
        sum(map(bytes.__eq__, words, words[1:])) / pairs,
        len(set(lines)) / max(1, len(lines)),
        sum(map(bytes.isupper, words)) / n,
        np.log1p(len(words) / max(1, len(lines))),
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def output(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x), -30, 30)))


def trained(positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """The network with the least non-negative risk, by Adam over mini-batches of both samples."""
    every = np.concatenate([positives, unlabelled]) if len(positives) + len(unlabelled) else np.zeros((1, N_FEATURES))
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    model = Model(mean, scale, w)
    if not len(positives) or not len(unlabelled):
        return model
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positives, unlabelled))
    first, second, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for _ in range(EPOCHS):
        orders = [rng.permutation(len(x)) for x in (p, u)]
        for at in range(0, max(len(p), len(u)), BATCH):
            xp, xu = (x[o[np.arange(at, at + BATCH) % len(x)]] for x, o in zip((p, u), orders, strict=True))
            x = np.concatenate([xp, xu])
            hidden = np.tanh(x @ w[0] + w[1])
            good = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30)))  # the loss as bad; 1 - good: as good
            slope = good * (1 - good)
            is_p = np.arange(len(x)) < len(xp)
            share = np.where(is_p, 1 / len(xp), 1 / len(xu))
            negative = good[~is_p].mean() - prior * good[is_p].mean()
            # Where the negative part is below zero, only that part is driven up again.
            as_bad = np.where(is_p, -prior, 1.0) * (1.0 if negative >= 0 else -1.0)
            as_good = np.where(is_p, -prior, 0.0) * (1.0 if negative >= 0 else 0.0)
            g = (as_bad + as_good) * share * slope
            back = np.outer(g, w[2]) * (1 - hidden**2)
            grads = [x.T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ g, np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                w[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among the unlabelled: a network trained on one half of both samples scores the other."""
    if len(positives) < 4 or len(unlabelled) < 4:
        return 0.5
    model = trained(positives[::2], unlabelled[::2], 0.5)
    p, u = np.sort(model.score(positives[1::2])), np.sort(model.score(unlabelled[1::2]))
    thresholds = np.quantile(p, 1 - KEPT)
    above = [1 - np.searchsorted(x, thresholds, side="left") / len(x) for x in (u, p)]
    ratio = above[0] / above[1]
    at = int(ratio.argmin())
    # The least of noisy ratios, less its standard error.
    error = np.sqrt(sum((1 - a[at]) / max(a[at], 1e-9) / len(x) for a, x in zip(above, (u, p), strict=True)))
    return float(np.clip(ratio[at] * (1 - error), *PRIOR_RANGE))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def _sampled(ids: DataFrame, size: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of the documents.

    Only rows outside the held-out fold train. An id is a trusted positive if all its labels say 1; null labels don't
    count. Null and empty texts get the score of a text without features. Without labels or documents to learn from
    the network stays as it began. Repeated rows each get a row, with the same score; in
    training an id counts once, with the smallest of its feature rows. Equal scores are equal predictions. Very long texts
    are read whole. Further columns, whatever their names, are left out.
    """
    texts = id_and_text(docs)
    apart = fold(F.col("doc_id"), folds) != held
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].alias("quality"))
    known = known.where(apart & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    positives = _sampled(known.where("quality = 1").select("doc_id"), SAMPLE).withColumn("kind", F.lit(1))
    web = texts.where(apart & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    web = _sampled(web, SAMPLE).withColumn("kind", F.lit(0))
    # At most 2 * SAMPLE ids: small at any size of the data.
    chosen = F.broadcast(positives.unionAll(web))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            rows = [features(t).tobytes() for t in raw(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("kind"), pa.array(rows, pa.binary())], ["doc_id", "kind", "x"]
            )

    described_rows = texts.join(chosen, "doc_id").mapInArrow(described, "doc_id bigint, kind int, x binary")
    # One row per id and kind, however often the id is there, so 2 * SAMPLE rows at most.
    sample = described_rows.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).collect()
    sample.sort(key=lambda r: (r.doc_id, r.kind, bytes(r.x)))
    parts = [
        np.array([np.frombuffer(r.x, dtype=np.float32) for r in sample if r.kind == k], dtype=np.float64).reshape(-1, N_FEATURES)
        for k in (1, 0)
    ]
    model = trained(*parts, estimated_prior(*parts))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            x = np.array([features(t) for t in raw(part.column("text"))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    result = texts.mapInArrow(scored, "doc_id bigint, score double")
    return result.select(
        "doc_id", (~apart).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
