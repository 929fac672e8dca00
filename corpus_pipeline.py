"""The corpus pipeline: quality, near duplicates, secrets, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, jaccard, mixing, quality, secrets
from millrace.llm.tables import stored, table

#: The vocabulary of the last stage.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of the documents' columns (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts good; it learns from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(~quality.held_out(4, 2))
    (aside,) = unused(docs, "given_score")  # a column named score is the documents' own
    given = [c for c in docs.columns if c.lower() == "score"]
    kept = docs.withColumnsRenamed({c: aside for c in given})
    good = quality.classify(kept, quality.fit(docs.select("doc_id", "text"), labels)).filter(F.col("score") >= quality.GOOD).drop("score")
    return good.withColumnsRenamed({aside: c for c in given}).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), that of the least doc_id;
    null ids come last. Groups are told apart by their texts, not by doc_id.

    Documents without words are in no group and stay. Repeated rows stay once.
    """
    (key,) = unused(docs, "key")
    groups = jaccard.near_roots(docs, words=5, percent=80)
    least = groups.filter("n_shingles > 0").groupBy("root").agg(F.min(jaccard.row_order()).alias("row"))
    stays = least.select("row.doc_id", "row.text_key").unionByName(groups.filter("n_shingles = 0").select("doc_id", "text_key").distinct())
    keyed = docs.withColumn(key, F.struct("doc_id", jaccard.text_key()))
    stays = stays.select(F.struct("doc_id", "text_key").alias(key))
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask; ``n_chars`` follows where the text changed."""
    (before,) = unused(docs, "before")
    clean = secrets.redact(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 2 times).

    Rows are named by doc_id and a hash of the text; repeated rows share what they take, rounded up.
    """
    key, copies, copy = unused(docs, "key", "copies", "copy")
    keyed = docs.withColumn(key, F.struct("doc_id", jaccard.text_key()))
    taken = mixing.mix(keyed.select(F.col(key).alias("doc_id"), "source", "text")).filter("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias(key)).agg(F.ceil(F.avg("copies")).cast("int").alias(copies))
    return keyed.join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, starts): the ids of each text, and the byte at which each token begins."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), RANKS)
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts")


#: (name, function), in order.
STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", without_near_duplicates),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages leave of the documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs


#: The classifier and the entropy balancing have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None
