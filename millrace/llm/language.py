"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import widened

#: Lengths of n-grams; buckets that they are hashed to; documents learnt from, at most; smoothing.
GRAMS, BUCKETS, SAMPLE, SMOOTH = (1, 2, 3), 1 << 15, 20_000, 0.5
#: Code points looked at together, about.
CHUNK = 1 << 20
UNKNOWN = "und"
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


class Model(NamedTuple):
    """Languages, and their log probabilities by bucket: len(languages) * BUCKETS numbers."""

    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


_LETTER: np.ndarray | None = None


def chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(first code point of each text, a bucket per code point for each length, letters of each text).

    Texts are lower-cased; what isn't a letter is a blank, as is the end of a text, and
    blanks after blanks count no n-gram (their buckets are -1).
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    firsts = np.cumsum([0, *(len(t) + 1 for t in lowered)])[:-1]
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32))
    out, code = [], np.zeros(len(points), np.uint32)
    padded = np.concatenate([points, np.full(max(GRAMS), 32, np.uint32)])
    for n in range(1, max(GRAMS) + 1):
        code = code * np.uint32(31) + padded[n - 1 : n - 1 + len(points)] * MULTIPLIERS[n - 1]
        if n in GRAMS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(((mixed ^ np.uint32(n * 0x51ED27)) >> np.uint32(17)).astype(np.int32))
    return firsts, [np.where(letter, b, -1) for b in out], np.add.reduceat(letter, firsts, dtype=np.int64)


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text, with its probability; UNKNOWN with 0 where no letter is."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    firsts, buckets, letters = grams(texts)
    table = np.vstack([model.log_likelihood.T, np.zeros(len(model.languages))]).astype(np.float32)
    total = sum(np.add.reduceat(table[b], firsts, axis=0, dtype=np.float64) for b in buckets) + model.log_prior
    best = total.argmax(1)
    chance = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    known = letters > 0
    return [model.languages[i] if k else UNKNOWN for i, k in zip(best, known)], np.where(known, chance, 0.0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from documents with a language, at most ``sample``, those of the smallest hashes of doc_id.

    Tasks count n-grams by language; their counts are summed by Spark and come to the
    driver as one number for each language and bucket that occurs.
    """
    known = docs.filter(F.col("lang").isNotNull())
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    taken = known.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                sums = np.zeros(BUCKETS + 1, np.int64)
                for part in chunks(group["text"].tolist()):
                    for b in grams(part)[1]:
                        sums += np.bincount(b + 1, minlength=BUCKETS + 1)
                used = np.flatnonzero(sums[1:])
                yield pd.DataFrame({"lang": lang, "bucket": used, "n": sums[1:][used], "docs": 0})
                yield pd.DataFrame({"lang": [lang], "bucket": [-1], "n": [0], "docs": [len(group)]})

    rows = taken.mapInPandas(count, "lang string, bucket int, n long, docs long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.full((len(languages), BUCKETS), SMOOTH)
    index = {lang: i for i, lang in enumerate(languages)}
    which = rows["lang"].map(index).to_numpy(np.int64)
    seen = rows["bucket"].to_numpy() >= 0
    counts[which[seen], rows["bucket"].to_numpy()[seen]] += rows["n"].to_numpy()[seen]
    docs_of = np.bincount(which, rows["docs"].to_numpy(np.float64), len(languages)) + 1
    return Model(languages, np.log(docs_of / docs_of.sum()) if languages else docs_of, np.log(counts / counts.sum(1, keepdims=True)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the documents; columns of these names are replaced."""
    kept = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [predict(sent.value, part) for part in chunks(batch[text].fillna("").tolist())]
            yield batch.assign(lang_pred=[x for f, _ in found for x in f], score=np.concatenate([s for _, s in found]) if found else np.zeros(0))

    return kept.mapInPandas(run, widened(kept.schema, "lang_pred string", "score double"))
