"""Mixing sources to target weights by entropy balancing.

Every source has a token target. Among all document rates in (0, 2) that meet the
targets, entropy balancing picks those nearest to 1 in (bounded) relative entropy.
Its dual is convex and separates by source into one unknown, the tilt t, with
``rate = 2 / (1 + exp(-t * size / mean size))``. Newton steps on the dual are Spark
aggregations over the (source, size) histogram, so their cost follows the number of
distinct sizes, not of documents. Rates then become whole copies by systematic
rounding inside small groups of documents of like size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import WORD, stored, text_of

#: Relative weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix's size over the size of all documents; the most that a source or document gives.
SHARE, MOST = 1.5, 2.0
#: Documents in a rounding group, about; more are spread over several groups by a hash.
GROUP = 512
#: Newton steps in one job, and jobs at most.
STEPS, ROUNDS = 5, 16
TOLERANCE = 1e-9
#: Rates are whole multiples of 1 / UNIT, so that their sums don't depend on the order of rows.
UNIT = 1 << 20


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Number of words of the text; null counts 0."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_index(sources: DataFrame) -> DataFrame:
    """Numbers sources from 0 by code point, null last.

    Ranges of sources are numbered side by side and shifted by the counts of the
    ranges before them, of which there are as many as shuffle partitions.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "sources")
    before, total = [], 0
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    shift = F.element_at(F.array(*map(F.lit, before or [0])), F.col("part") + 1)
    number = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + shift
    return ranged.withColumn("sid", number.cast("long")).drop("part")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (sid, source_size).

    The targets are weight * level, at most ``most`` times the source's size. The
    level rises as capped sources free their excess, until no more get capped.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    framed = sources.withColumn("weight", weight)
    cap = most * F.col("source_size")
    total = framed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, None
    while total:
        over = F.col("weight") * level > cap
        row = framed.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count_if(over).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["free"]:
            break
        capped, level = row["capped"], (share * total - row["fixed"]) / row["free"]
    return framed.withColumn("target", F.least(F.col("weight") * level, cap)).drop("weight")


def tilts(histogram: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """Solves the dual: (sid, tilt) for every source whose target lies inside (0, most * size).

    From tilt 0 Newton's steps move towards the root from one side only, since each
    rate is concave above and convex below it, so no line search is needed.
    """
    open_ = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    state = sources.filter(open_).select("sid", "target", F.lit(0.0).alias("tilt"), F.lit(1.0).alias("miss"))
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            rate = most / (1 + F.exp(-F.col("tilt") * F.col("z")))
            given = F.col("n") * F.col("size")
            sums = histogram.join(state, "sid").groupBy("sid", "target", "tilt").agg(
                F.sum(given * rate).alias("got"),
                F.sum(given * F.col("z") * rate * (1 - rate / most)).alias("slope"),
            )
            step = F.when(F.col("slope") > 0, (F.col("target") - F.col("got")) / F.col("slope")).otherwise(0.0)
            state = sums.select(
                "sid", "target", (F.col("tilt") + step).alias("tilt"), (F.abs(F.col("got") / F.col("target") - 1)).alias("miss")
            )
        state = stored(state, "tilts")
        if (state.agg(F.max("miss")).first()[0] or 0) < TOLERANCE:
            break
    return state.select("sid", "tilt")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Copies of each document: (doc_id, source, size, source_size, target, rate, copies, taken).

    ``docs`` has doc_id, source and text; other columns are not used. A null text or
    one without words has size 0 and gives nothing. Null sources are one source, the
    last. Repeated rows count as rows of their own. An empty table gives no rows.
    ``taken`` is copies * size with copies 0 to 2; the same input gives the same rows.
    """
    base = stored(docs.select("doc_id", "source", sizes(docs).alias("size")), "sizes")
    counted = base.groupBy("source", "size").agg(F.count("*").alias("n"))
    counted = stored(counted, "histogram")
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_n"))
    sources = stored(targets(source_index(totals)), "targets")
    known = counted.join(sources, counted["source"].eqNullSafe(sources["source"])).select(
        counted["source"], "size", "n", "sid", "source_size", "target",
        (F.col("size") * F.col("source_n") / F.greatest(F.col("source_size"), F.lit(1))).alias("z"),
    )
    known = stored(known, "known")
    solved = tilts(known.select("sid", "size", "n", "z"), sources.select("sid", "source_size", "target"))
    tilted = MOST / (1 + F.exp(-F.col("tilt") * F.col("z")))
    stratum = F.floor(4 * F.log2(F.col("size") + F.lit(1.0))).cast("int")
    groups = F.ceil(F.sum("n").over(W.partitionBy("sid", "stratum")) / GROUP).cast("int")
    rates = (
        known.join(solved, "sid", "left")
        .withColumn("rate", F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNotNull(), tilted).when(F.col("target") > 0, MOST).otherwise(0.0))
        .withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
        .withColumn("stratum", stratum)
        .withColumn("groups", groups)
        .select(F.col("source").alias("of"), F.col("size").alias("sized"), "sid", "source_size", "target", "units", "stratum", "groups")
    )
    rates = stored(rates, "rates")
    drawn = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    placed = base.join(rates, base["source"].eqNullSafe(rates["of"]) & (base["size"] == rates["sized"]))
    placed = placed.withColumn("drawn", drawn).withColumn("salt", F.pmod(F.col("drawn"), F.col("groups")))
    group = W.partitionBy("sid", "stratum", "salt").orderBy("size", "drawn", "doc_id")
    start = F.pmod(F.xxhash64(F.lit(seed), "sid", "stratum", "salt"), F.lit(UNIT))
    upto = start + F.sum("units").over(group.rowsBetween(W.unboundedPreceding, 0))
    copies = (F.floor(upto / UNIT) - F.floor((upto - F.col("units")) / UNIT)).cast("int")
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("units") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )
