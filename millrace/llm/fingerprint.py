"""Document fingerprints by consistent weighted sampling.

For sample k a term of weight w draws, from hashes of (k, term) alone, r and c from
Gamma(2, 1) and b from [0, 1); with t = floor(ln w / r + b) its value is
``a = c exp(-r (t + 1 - b))``. A document keeps the least value of its terms. Two
documents keep the same value with a chance of sum(min weights) / sum(max weights),
their generalised Jaccard similarity. The value names its (term, t), so it is the
sample, and a fingerprint is so many minima: plain aggregations over exploded terms.

A Gamma(2, 1) number is the sum of two exponential ones and their share is uniform, so
with e = -ln u and f = -ln v the draws are r = e + f and b = e / r. Then
``t = floor((ln w + e) / r)`` and ``a = c v exp(-r t)``. A weight of 1 has t = 0 always,
and needs neither u nor r: most words of a text occur once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import text_of

#: Samples of a fingerprint, in rows of so many; ranges of neighbouring documents for each shuffle partition.
SAMPLES, IN_ROW, RANGES = 64, 4, 4
#: Bits of a uniform number; three are cut from one hash.
BITS = 21
LEAST_ID = -(1 << 63)


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (range, at, ghost, doc_id, text, next_text) of (doc_id, text), null texts empty.

    ``next_text`` is the text of the next document, descending by doc_id (nulls last) and
    ascending by text, and after the last that of the first. Documents are dealt to
    ranges between quantiles of their ids, shuffled once. Each range also gets the first
    document after it, as a ghost, so that neighbours meet in their range at ``at`` and
    ``at + 1``. What the driver holds are the cuts and tops of the ranges, whose number
    follows the shuffle partitions.
    """
    spark = docs.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(LEAST_ID)))
    cuts = docs.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    listed = F.array(*map(F.lit, cuts)) if cuts else F.expr("cast(array() as array<bigint>)")
    docs = docs.withColumn("range", F.size(F.filter(listed, lambda c: c <= F.col("id"))))
    tops = sorted(tuple(r) for r in docs.groupBy("range").agg(F.max("id")).collect())
    after = [(rank, top, tops[(i + 1) % len(tops)][0]) for i, (rank, top) in enumerate(tops)]
    ghosts = spark.createDataFrame(after, "range int, top long, goes_to int")
    here = F.struct(F.col("range"), F.lit(0).alias("ghost"))
    there = F.struct(F.col("goes_to").alias("range"), F.lit(1).alias("ghost"))
    placed = docs.join(F.broadcast(ghosts), "range").select("doc_id", "id", "text", F.explode(F.when(F.col("id") == F.col("top"), F.array(here, there)).otherwise(F.array(here))).alias("x"))
    order = W.partitionBy("range").orderBy("ghost", F.desc("id"), F.col("doc_id").isNull(), "text")
    placed = placed.select("x.range", "x.ghost", "doc_id", "id", "text")
    return placed.select("range", F.row_number().over(order).alias("at"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the next document."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def minima(terms: DataFrame, keys: list[str], weights: dict[str, str], samples: int = SAMPLES, mark: str | None = None) -> DataFrame:
    """(keys, a column for each of ``weights``): samples of weighted terms, as arrays of numbers.

    ``terms`` has keys, ``term`` (a hash) and columns of weights; a weight that is null or
    0 takes no part, and keys without any weight get null. ``weights`` names the result of
    each column of weights. Terms for which the column ``mark`` is over 0 are no hashes but
    parts of something to be carried along, part << 32 | value, and come back as the array
    of that name. Where ``terms`` is dealt by some of the keys nothing is shuffled.
    """
    # Equal weights of a term have equal values, which are found once.
    known = [F.coalesce(F.col(w).cast("double"), F.lit(0.0)) for w in weights]
    rows = terms.select(*keys, "term", *weights, *([mark] if mark else []), F.explode(F.array_distinct(F.array(*known))).alias("w"))
    rows = rows.filter((F.col("w") > 0) | (sum(known[1:], known[0]) == 0))
    rows = rows.withColumn("log_w", F.log("w")).withColumn("first", F.explode(F.array(*map(F.lit, range(0, samples, IN_ROW)))))
    one = 1.0 / (1 << BITS)

    def uniform(hashed: Column, place: int) -> Column:
        return (F.shiftrightunsigned(hashed, BITS * place).bitwiseAND((1 << BITS) - 1) + 0.5) * one

    rows = rows.withColumns({f"hash{j}": F.xxhash64("term", F.col("first") + j) for j in range(IN_ROW)})
    drawn = {}
    for j in range(IN_ROW):
        hashed = F.col(f"hash{j}")
        v = uniform(hashed, 0)
        once = -F.log(uniform(hashed, 1) * uniform(hashed, 2)) * v
        u = uniform(F.xxhash64("term", F.col("first") + j, F.lit(1)), 0)
        t = F.floor((F.log(u) - F.col("log_w")) / F.log(u * v))
        drawn[f"value{j}"] = once * F.when(F.col("w") == 1, 1.0).otherwise(F.pow(u * v, t))
    rows = rows.withColumns(drawn)
    least = [F.min(F.when(F.col(name) == F.col("w"), F.col(f"value{j}"))).alias(f"{name}_{j}") for name in weights for j in range(IN_ROW)]
    if mark:
        part = (F.col(mark) > 0) & (F.shiftright("term", 32) == F.col("first") / IN_ROW)
        least.append(F.max(F.when(part, F.col("term").bitwiseAND(0xFFFFFFFF))).alias(mark))
    found = rows.groupBy(*keys, "first").agg(*least)
    numbers = {name: F.array(*[F.hash(f"{name}_{j}") for j in range(IN_ROW)]) for name in weights}
    found = found.select(*keys, "first", *([mark] if mark else []), *[F.when(F.col(f"{name}_0").isNotNull(), n).alias(name) for name, n in numbers.items()])
    whole = [F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("first", name)))).alias(name) for name in weights]
    joined = [F.when(F.size(name) > 0, F.flatten(F.col(f"{name}.{name}"))).alias(out) for name, out in weights.items()]
    if mark:
        whole.append(F.sort_array(F.collect_list(F.struct("first", mark))).alias(mark))
        joined.append(F.col(f"{mark}.{mark}").alias(mark))
    return found.groupBy(*keys).agg(*whole).select(*keys, *joined)


def words(texts: DataFrame, keys: list[str], columns: list[str], digest: str) -> DataFrame:
    """(keys, term, a count for each text column, ``mark``): the words of each text, in small letters, as hashes.

    ``digest`` is a column of 64 hexadecimal digits or null; its eight parts are terms too,
    part << 32 | value, for which ``mark`` counts. It travels with the words because the
    rows are too many to be joined to it again. Rows without any get one with a null term.
    """
    parts = F.array_join(F.array(*[F.substring(digest, 8 * i + 1, 8) for i in range(8)]), " ")
    said = [F.struct(F.lit(i).alias("of"), F.coalesce(F.col(c), F.lit("")).alias("said")) for i, c in enumerate(columns)]
    each = F.explode(F.array(*said, F.struct(F.lit(-1).alias("of"), F.coalesce(parts, F.lit("")).alias("said")))).alias("x")
    split = F.posexplode(F.split(F.lower("x.said"), r"[\x20\x09-\x0D]+", -1)).alias("nth", "word")
    found = texts.select(*keys, each).select(*keys, F.col("x.of").alias("of"), split)
    part = F.shiftleft(F.col("nth").cast("long"), 32).bitwiseOR(F.conv("word", 16, 10).cast("long"))
    term = F.when(F.col("word") != "", F.when(F.col("of") >= 0, F.xxhash64("word")).otherwise(part))
    counts = [F.sum(F.when((F.col("of") == i) & F.col("term").isNotNull(), 1).otherwise(0)).alias(c) for i, c in enumerate(columns)]
    marks = F.sum(F.when((F.col("of") < 0) & F.col("term").isNotNull(), 1).otherwise(0)).alias("mark")
    return found.select(*keys, "of", term.alias("term")).groupBy(*keys, "term").agg(*counts, marks)


def likeness(left: Column, right: Column) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity.

    Texts without words are like each other and unlike all others.
    """
    equal = F.aggregate(F.zip_with(left, right, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(left.isNull() & right.isNull(), 1.0).when(left.isNull() | right.isNull(), 0.0).otherwise(equal / F.size(left))


def spelled(samples: Column, count: int = SAMPLES) -> Column:
    """A fingerprint as text: eight hexadecimal digits a sample, all 0 where there are no words."""
    digits = F.transform(samples, lambda x: F.lpad(F.right(F.hex(x), F.lit(8)), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit("0" * 8 * count))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, samples, edited_samples, near_edited, near_next).

    ``docs`` has doc_id and text. Repeated rows are documents of their own, equal texts
    have equal samples, texts without words have null samples.
    """
    placed = neighbours(docs)
    changed = F.when(F.col("ghost") == 0, edited(F.col("text"), F.col("next_text")))
    size = F.char_length("text").cast("long")
    placed = placed.select("range", "at", "ghost", "doc_id", size.alias("n_chars"), "text", changed.alias("edited")).withColumn("digest", F.sha2("edited", 256))
    keys = ["range", "at", "ghost", "doc_id", "n_chars"]
    terms = words(placed, keys, ["text", "edited"], "digest")
    found = minima(terms, keys, {"text": "samples", "edited": "edited_samples"}, mark="mark")
    following = F.lead("samples").over(W.partitionBy("range").orderBy("at"))
    digest = F.array_join(F.transform("mark", lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    return found.withColumn("next_samples", following).filter(F.col("ghost") == 0).select(
        "doc_id", "n_chars", digest.alias("edited_sha256"), "samples", "edited_samples",
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"), likeness(F.col("samples"), F.col("next_samples")).alias("near_next"),
    )
