"""Quality classifier: a factorisation machine.

Features are hashed words, with weights of unit length, and standardised statistics of
the text's structure. Every feature i has a weight w[i] and a short vector v[i]; pairs
of features add <v[i], v[j]> x[i] x[j]. All pairs together are
``(|sum v[i] x[i]| ** 2 - sum |v[i] x[i]| ** 2) / 2``, so a score costs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .tables import widened

#: Buckets of hashed words; length of the vectors; labelled rows that are learnt from, at most.
BUCKETS, RANK, SAMPLE = 1 << 14, 8, 4000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 128, 0.02, 1e-4, 11
#: Score from which a document is predicted good.
GOOD = 0.7
#: Characters whose shares are statistics.
SYMBOLS = b"$%&#*|<>{}[]\\^~=_@+/"
STATS = ("log_bytes", "log_words", "word_bytes", "distinct", "upper", "digit", "symbol", "exclaim", "stop", "comma", "lines", "not_ascii", "short", "long", "repeat")


class Model(NamedTuple):
    """Fixed in size: BUCKETS + len(STATS) features. ``base`` alone is the score where no two labels were seen."""

    base: float
    weight: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of hashed words, and the statistics of each text (a row of STATS)."""
    n = len(texts)
    hashes, length, which, data = textscan.words(texts, lower=True)
    key, counts = np.unique(which * BUCKETS + (hashes >> np.uint64(50)).astype(np.int64), return_counts=True)
    doc, bucket = key // BUCKETS, key % BUCKETS
    value = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(doc, value**2, n))
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum(sizes + 1) - sizes - 1

    def share(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[raw], firsts, dtype=np.int64) / np.maximum(sizes, 1)

    def chars(some: bytes) -> np.ndarray:
        table = np.zeros(256, np.int64)
        table[list(some)] = 1
        return table

    total = np.maximum(np.bincount(which, minlength=n), 1)
    per_word = lambda x: np.bincount(which, x, n) / total
    stats = np.stack([
        np.log1p(sizes), np.log1p(total), per_word(length), np.bincount(doc, minlength=n) / total,
        share(chars(bytes(range(65, 91)))), share(chars(b"0123456789")), share(chars(SYMBOLS)), share(chars(b"!?")), share(chars(b".")), share(chars(b",;:")), share(chars(b"\n")),
        share(chars(bytes(range(128, 256)))), per_word(length <= 2), per_word(length >= 15),
        np.maximum.reduceat(np.append(counts, 0), np.minimum(np.searchsorted(doc, np.arange(n)), len(counts))) / total,
    ], 1)
    return doc, bucket, value / norm[doc], stats


def _raw_scores(model: Model, doc: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and the sums of v x of each text."""
    order = np.searchsorted(doc, np.arange(n))
    scaled = model.vectors[index] * value[:, None]
    both = np.concatenate([scaled, (scaled**2).sum(1, keepdims=True), (model.weight[index] * value)[:, None]], 1)
    sums = np.add.reduceat(both, order, axis=0)
    return model.base + sums[:, -1] + ((sums[:, :RANK] ** 2).sum(1) - sums[:, RANK]) / 2, sums[:, :RANK]


def _joined(model: Model, doc, bucket, value, stats):
    """Words and statistics of each text as one list of features, by text; every text has the statistics."""
    n = len(stats)
    scaled = np.clip((stats - model.mean) / model.spread, -4, 4) / 2
    docs = np.concatenate([doc, np.repeat(np.arange(n), len(STATS))])
    index = np.concatenate([bucket, np.tile(BUCKETS + np.arange(len(STATS)), n)])
    order = np.argsort(docs, kind="stable")
    return docs[order], index[order], np.concatenate([value, scaled.ravel()])[order]


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores from 0 to 1, higher for texts that labels of 1 are likelier for."""
    if not len(model.weight):
        return np.full(len(texts), model.base)
    joined = _joined(model, *features(texts))
    raw, _ = _raw_scores(model, *joined, len(texts))
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Fits by stochastic steps (Adam) on the logistic loss, in a fixed order."""
    good = float(labels.sum())
    none = np.zeros(0)
    if good in (0, len(labels)):
        return Model((good + 1) / (len(labels) + 2), none, none, none, none)
    parts = [features(part) for _, part in textscan.chunks(texts)]
    at = np.cumsum([0, *(len(p[3]) for p in parts)])
    doc = np.concatenate([p[0] + a for p, a in zip(parts, at)])
    bucket, value = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    stats = np.concatenate([p[3] for p in parts])
    rng = np.random.default_rng(SEED)
    size = BUCKETS + len(STATS)
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)), stats.mean(0), stats.std(0) + 1e-6)
    docs, index, value = _joined(model, doc, bucket, value, stats)
    first = np.searchsorted(docs, np.arange(len(labels) + 1))
    theta = np.concatenate([model.weight[:, None], model.vectors], 1)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    base, step = float(np.log(good / (len(labels) - good))), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            take = np.concatenate([np.arange(first[d], first[d + 1]) for d in some])
            row = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
            x, j = value[take], index[take]
            raw, sums = _raw_scores(Model(base, theta[:, 0], theta[:, 1:], *model[3:]), row, j, x, len(some))
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
            slope = np.concatenate([np.ones((len(x), 1)), sums[row] - theta[j, 1:] * x[:, None]], 1) * (off[row] * x)[:, None]
            used, where = np.unique(j, return_inverse=True)
            total = np.stack([np.bincount(where, slope[:, k]) for k in range(1 + RANK)], 1) + DECAY * theta[used]
            step += 1
            moment[used] = 0.9 * moment[used] + 0.1 * total
            square[used] = 0.999 * square[used] + 0.001 * total**2
            theta[used] -= RATE * (moment[used] / (1 - 0.9**step)) / (np.sqrt(square[used] / (1 - 0.999**step)) + 1e-8)
            base -= RATE * off.sum()
    return Model(base, theta[:, 0], theta[:, 1:], model.mean, model.spread)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled documents, those of the smallest hashes of doc_id.

    Labels other than 0 and 1 are left out, and rows of documents without text count as
    empty. The sample is bounded, so it fits the driver, and is the same in every run.
    """
    marked = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    taken = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    rows = taken.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "quality").limit(sample).toPandas()
    return train(rows["text"].tolist(), rows["quality"].to_numpy(np.float64))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` to the documents (null texts are empty); columns of that name are replaced."""
    kept = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [score(sent.value, part) for _, part in textscan.chunks(batch[text].fillna("").tolist())]
            yield batch.assign(score=np.concatenate(scores) if scores else np.zeros(0))

    return kept.mapInPandas(run, widened(kept.schema, "score double"))


def held_out(modulus: int, rest: int):
    """Whether the crc32 of the doc_id's digits leaves the rest; a null doc_id counts as no digits."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == rest
