"""Bounded pools of news for all users, less what each may not see.

Every news of a pool has a bit, and a user's exclusions are a sparse bitmap over the bits:
exclusions meet the pool, which is broadcast, before they are shuffled, and a user's list
is the pool's list filtered inside the user's row. No table of users times news is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: how many times a limit is fetched before exclusions.
FETCHED = 4


def numbered(pool: DataFrame, *order: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows of a pool with ``place`` from 0; only they meet in one task."""
    top = pool.orderBy(*order).limit(limit)
    return top.withColumn("place", (F.row_number().over(W.orderBy(*order)) - 1).cast("int"))


def listed(pool: DataFrame) -> Column:
    """A bounded pool (news_id, bit, place, ...) as one array in order of place, computed once for all rows."""
    return pool.agg(F.sort_array(F.collect_list(F.struct("place", *[c for c in pool.columns if c != "place"])))).scalar()


def barred_bits(exclude: DataFrame, universe: DataFrame) -> DataFrame:
    """(user_id, barred): the bits of a user's exclusions among the universe (news_id, bit), as a map from words to 64 bits.

    The universe is bounded by the pools' limits, so it is broadcast and only exclusions of its news are shuffled.
    """
    met = exclude.join(F.broadcast(universe.select("news_id", "bit")), "news_id")
    words = met.groupBy("user_id", (F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits"))
    return words.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("barred"))


def free(entry: Column, barred: Column) -> Column:
    """Whether a pool's entry is not among a row's exclusions."""
    word = F.try_element_at(barred, (entry["bit"] / 64).cast("int"))
    return F.coalesce(F.getbit(word, (entry["bit"] % 64).cast("int")) == 0, F.lit(True))


def first(entries: Column, count) -> Column:
    return F.slice(entries, 1, count)


def free_lists(pool: DataFrame, users: DataFrame, exclude: DataFrame, limit: int, of: DataFrame | None = None) -> DataFrame:
    """(user_id, pos, *pool): of a bounded pool (news_id, place, ...) each user's first ``limit`` that aren't excluded.

    ``of`` (user_id, ...) may give more columns of a user.
    """
    bits = pool.withColumn("bit", F.col("place"))
    rows = users.select("user_id").join(barred_bits(exclude, bits), "user_id", "left").withColumn("pool", listed(bits))
    more = [c for c in of.columns if c != "user_id"] if of is not None else []
    rows = rows.join(of, "user_id", "left") if more else rows
    kept = first(F.filter("pool", lambda x: free(x, F.col("barred"))), limit)
    return rows.select("user_id", *more, F.posexplode(kept).alias("pos", "x")).select("user_id", *more, "pos", "x.*").drop("bit")
