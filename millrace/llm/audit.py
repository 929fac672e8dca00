"""How quality filters interact, audited over a sparse document-term matrix.

Words are coded by a dictionary of the whole corpus and documents are rows of a matrix
in CSR form, in shards. A row's sum is its number of words and its number of entries that
of its distinct words; they decide two of five filters. The others look at characters and
at texts that came before. Of every part of the corpus only the number of documents
for each set of failed filters is kept, and all orders of the filters are read off those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count, permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shards import flat, write_shards
from .tables import stored

# Words that a document has at least; distinct words and capitals in a hundred; characters that bar it.
LEAST_WORDS, DISTINCT, CAPITALS, BARRED = 200, 50, 3, b"#$%&*|"
CAPITAL = bytes(range(65, 91))
#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: Hash buckets of the dictionary; each is one Python dictionary in one task at a time.
BUCKETS = 4096
#: What is counted of a text's characters besides its words.
MARKS = "points array<bigint>, capitals array<bigint>, barred array<bigint>"


def _coded(texts: list[bytes]) -> dict:
    """The texts' words by a dictionary of their own, as CSR rows, and counts of their characters."""
    said = [t.split() for t in texts]  # bytes are split at ASCII white space alone
    code = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(said)))}
    codes = np.fromiter(map(code.__getitem__, chain.from_iterable(said)), np.int64)
    # Words are numbered bucket by bucket, and a bucket's words travel as one string.
    bucket = np.fromiter(map(crc32, code), np.int64, len(code)) % BUCKETS
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(code), np.int64)
    place[order] = np.arange(len(code))
    full, begin = np.unique(bucket[order], return_index=True)
    words = [*code]
    words = [words[i] for i in order.tolist()]
    joined = [b" ".join(words[a:b]) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(words)])]
    entries = pa.StructArray.from_arrays([pa.array(full, pa.int32()), pa.array(joined, pa.binary()).cast(pa.string())], ["bucket", "words"])
    row = np.repeat(np.arange(len(said)), [len(w) for w in said])
    key, times = np.unique(row << 32 | place[codes] if len(codes) else codes, return_counts=True)
    indptr = np.searchsorted(key, np.arange(len(said) + 1) << 32)
    return {
        "entries": entries, "indptr": indptr, "indices": key & 0xFFFFFFFF, "data": times,
        "points": [len(t.decode()) for t in texts], "capitals": [len(t) - len(t.translate(None, CAPITAL)) for t in texts], "barred": [len(t) - len(t.translate(None, BARRED)) for t in texts],
    }


def _numbered(entries: DataFrame) -> DataFrame:
    """(shard, bucket, codes, fresh), written: for entries (shard, bucket, words) the number of each word in its bucket,
    and those of the words, joined by spaces, that no smaller shard has."""
    schema = "shard bigint, bucket int, codes array<int>, fresh string"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        last = None
        for batch in batches:
            codes, fresh = [], []
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != last:
                    known, last = {}, bucket
                words = words.split(" ")
                new = [word for word in words if word not in known]
                known.update(zip(new, count(len(known))))
                codes.append([*map(known.__getitem__, words)])
                fresh.append(" ".join(new) if new else None)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("bucket"), pa.array(codes, arrow.field("codes").type), pa.array(fresh, pa.string())], schema=arrow)

    return stored(entries.select("shard", "bucket", "words").repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(run, schema), "numbered")


def document_term_matrix(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(matrix, dictionary) of all words of all texts; a word is a longest run without ASCII white space.

    The dictionary is (word, idx), idx dense from 0. The matrix has a row for each shard:
    ``rows`` (the documents' columns besides the text), ``indptr``, ``indices`` (idx, in
    no order within a row) and ``data``, and for each document the numbers of its code
    points, capitals A-Z and barred characters. A null text is empty; empty tables give empty ones.
    """
    local = write_shards(docs, _coded, f"entries array<struct<bucket:int,words:string>>, indptr array<bigint>, indices array<int>, data array<int>, {MARKS}", "terms", text)
    numbered = _numbered(local.select("shard", F.inline("entries")))
    # The numbers of a bucket follow those of the buckets before it; there are BUCKETS of them.
    sizes = numbered.groupBy("bucket").agg(F.max(F.array_max("codes")).alias("most"))
    before = F.coalesce(F.sum(F.col("most") + 1).over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifted = numbered.join(F.broadcast(sizes.select("bucket", before.cast("long").alias("shift"))), "bucket")
    # A bucket's new words have its numbers in order, from the number of words that it had before.
    dictionary = shifted.filter("fresh IS NOT NULL")
    words = F.split("fresh", " ")
    dictionary = dictionary.select("shift", (F.array_max("codes") + 1 - F.size(words)).alias("first"), F.posexplode(words).alias("place", "word")).select("word", (F.col("shift") + F.col("first") + F.col("place")).alias("idx"))
    sent = shifted.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "shift", "codes"))).alias("x"))
    joined = local.drop("entries").join(sent.select("shard", F.col("x.shift").alias("shift"), F.col("x.codes").alias("codes")), "shard", "left")
    schema = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())) if f.name == "indices" else f for f in local.drop("entries").schema.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                indices, shift = (one.column(c).flatten().to_numpy() for c in ("indices", "shift"))
                codes = one.column("codes").flatten()
                idx = codes.flatten().to_numpy() + np.repeat(shift, pc.list_value_length(codes).to_numpy())
                coded = pa.array(idx[indices] if len(indices) else indices, pa.int64())
                coded = pa.ListArray.from_arrays(pa.array([0, len(coded)], pa.int32()), coded).cast(arrow.field("indices").type)
                yield pa.RecordBatch.from_arrays([coded if f.name == "indices" else one.column(f.name) for f in arrow], schema=arrow)

    return joined.mapInArrow(run, schema), dictionary


def row_statistics(matrix: DataFrame) -> DataFrame:
    """The documents' columns with ``n_words`` and ``n_distinct``, a row's sum and its number of entries, and the counts of characters."""
    row = matrix.schema["rows"].dataType.elementType
    schema = T.StructType([*row.fields, *T.StructType.fromDDL("n_words long, n_distinct long, points long, capitals long, barred long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                indptr, data = (one.column(c).flatten().to_numpy() for c in ("indptr", "data"))
                upto = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
                more = {c: one.column(c).flatten() for c in ("points", "capitals", "barred")}
                yield flat(one.column("rows").flatten(), more | {"n_words": np.diff(upto[indptr]), "n_distinct": np.diff(indptr)}, arrow)

    return matrix.mapInArrow(run, schema)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, n_words, n_distinct, failed): the bits of the filters that each document fails.

    A: few words; B: few distinct words; C: many capitals; D: a barred character; E: the
    text of a smaller doc_id. A null text is empty, a null lang the empty part. A document
    without an id has no smaller one, nor is it one. Repeated rows are documents each.
    """
    said = F.coalesce("text", F.lit(""))
    looks = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(said, 256)).alias("digest"), said.alias("text"))
    matrix, _ = document_term_matrix(looks)
    rows = stored(row_statistics(matrix), "statistics")
    # Only texts that several ids share are joined; one row each, whatever their number of copies.
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
    marked = rows.join(shared, "digest", "left")
    fails = {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": 100 * F.col("n_distinct") < DISTINCT * F.col("n_words"),
        "C": 100 * F.col("capitals") > CAPITALS * F.col("points"),
        "D": F.col("barred") > 0,
        "E": F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)),
    }
    failed = sum((F.when(fails[x], 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    return marked.select("doc_id", "part", "n_words", "n_distinct", failed.alias("failed"))


def interactions(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what the filter there removes of what is left.

    ``failed`` has doc_id, part and failed; ``labels`` doc_id, quality and toxic (1, 0 or
    null). A document is good or toxic where any of its label rows says so. Columns: part,
    filter_order, step, kept, removed, redundant (failing the filter, removed before),
    unique_fails (failing it alone), good_lost, toxic_lost, shapley (what the filter
    removes, summed over all orders). An empty table has no parts and no rows.
    """
    says = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(False)
    sets = failed.join(says, "doc_id", "left").groupBy("part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count("*").alias("n"))
    # A set of failed filters becomes a row for each order and step; the sets of a part are 32 times 4 at most.
    orders = ["".join(x) for x in permutations(FILTERS)]
    spread = sets.withColumn("filter_order", F.explode(F.array(*[F.lit(x) for x in orders])))
    spread = spread.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = spread.withColumns({
        "bit": F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{FILTERS}') - 1)"),
        "before": F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (m, i) -> m | shiftleft(1, locate(substring(filter_order, i, 1), '{FILTERS}') - 1))"),
    })
    fails, left = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) == 0
    number = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    share = F.col("n") * F.floor(F.lit(len(orders)) / F.greatest(F.bit_count("failed"), F.lit(1)))
    return steps.groupBy("part", "filter_order", "step").agg(
        number(left & ~fails).alias("kept"), number(left & fails).alias("removed"), number(~left & fails).alias("redundant"),
        number(F.col("failed") == F.col("bit")).alias("unique_fails"), number(left & fails & F.col("good")).alias("good_lost"),
        number(left & fails & F.col("toxic")).alias("toxic_lost"), F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("long").alias("shapley"),
    )
