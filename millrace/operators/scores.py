"""Scores of a bounded pool of news for all users at once (E12 to E14): an array a user, by place of the pool.

An entity that is asked for meets the entities of the pool once and has a row of its best similarities by place. Users
meet those rows in blocks, so no row is made for a user and a news, and a user's scores leave the task as one array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import MIXED_WEIGHT, PAIR_WEIGHTS

#: Entities and users of one block, and the numbers that a task holds at once besides its rows.
ASKED, USERS, HELD = 2048, 8192, 1 << 22


def _cosines(left, right):
    """Cosines of two columns of vectors: 0 for vectors of other lengths, of length 0 or with a null."""
    import numpy as np

    out = np.zeros((len(left), len(right)))
    a, b = ([np.asarray(v, np.float64) for v in side] for side in (left, right))
    for size in {len(v) for v in a} & {len(v) for v in b}:
        i, j = (np.array([k for k, v in enumerate(side) if len(v) == size]) for side in (a, b))
        x, y = (np.nan_to_num(np.stack([side[k] if np.isfinite(side[k]).all() else np.zeros(size) for k in places])) for side, places in ((a, i), (b, j)))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        out[np.ix_(i, j)] = x @ y.T
    return out


def pool_entities(pool: DataFrame, entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """(type, id, held, vector): the entities of a bounded pool (news_id, place) that have a vector, with the places of their news."""
    pool = F.broadcast(pool.select("news_id", "place"))
    met = entities.select("news_id", "type", "id").join(pool.select("news_id"), "news_id", "left_semi").join(pool, "news_id")
    return met.groupBy("type", "id").agg(F.sort_array(F.collect_set("place")).alias("held")).join(known_vectors(vectors), ["type", "id"])


def known_vectors(vectors: DataFrame) -> DataFrame:
    rows = vectors.filter(F.size("vector") > 0).select(F.lower("type").alias("type"), "id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.dropDuplicates(["type", "id"])


def pool_scores(query: DataFrame, held: DataFrame, size: int, vectors: DataFrame, boost: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(user_id, scores): for each query entity its best entity of the news, weighted and summed, plus the boost of shared
    stocks, by place from 0 to ``size`` - 1. Users of whom no entity has a vector have no row; news without entities score 0.

    ``query`` has (user_id, type, id, weight) and may have the frequency, which a boosted stock needs over 1; ``held`` are
    ``pool_entities``. Entities are named by a hash that tells all of them apart.
    """
    import numpy as np
    import pandas as pd

    known = query.select("type", "id").distinct().join(known_vectors(vectors), ["type", "id"])
    seed = 0
    while (told := known.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(F.lit(seed), "type", "id")).alias("codes")).first()).n > told.codes:
        seed += 1
    code = F.xxhash64(F.lit(seed), "type", "id").alias("code")
    size = max(size, 1)

    def similar(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sims, own = np.zeros((len(a), size)), {}
        if len(a) and len(b):
            places, owner = np.concatenate(b["held"].to_numpy()), np.repeat(np.arange(len(b)), [len(x) for x in b["held"]])
            order = np.argsort(places, kind="stable")
            news, starts = np.unique(places[order], return_index=True)
            own = {(t, i): p for t, i, p in zip(b["type"], b["id"], b["held"], strict=True)}
            weight = np.full((len(a), len(b)), MIXED_WEIGHT)
            for (x, y), w in PAIR_WEIGHTS.items():
                weight[np.ix_(a["type"] == x, b["type"] == y)] = w
            step = max(1, HELD // len(order))
            for i in range(0, len(a), step):
                near = np.maximum(_cosines(a["vector"].iloc[i : i + step], b["vector"]), 0) * weight[i : i + step]
                sims[i : i + step, news] = np.maximum.reduceat(near[:, owner[order]], starts, axis=1)
        places = [list(own.get(x, ())) for x in zip(a["type"], a["id"], strict=True)]
        return pd.DataFrame({"code": a["code"], "sims": list(sims), "places": places})

    blocks = -(-max(told.n, 1) // ASKED)
    left = known.withColumns({"code": code, "block": F.pmod(F.xxhash64("type", "id"), F.lit(blocks)).cast("int")})
    right = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    profiles = keep(left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(similar, "code long, sims array<double>, places array<int>"))

    def scored(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"user_id": [], "scores": []})
        if a.empty or b.empty:
            return none
        b = b.sort_values("named")
        codes, table, holds = b["named"].to_numpy(), np.stack(b["sims"].to_numpy()), np.zeros((len(b), size), np.int8)
        for i, x in enumerate(b["places"]):
            holds[i, x] = 1
        a = a[np.isin(a["code"].to_numpy(), codes)].groupby(["user_id", "code"], as_index=False).agg({"weight": "max", "boosted": "max"})
        if a.empty:
            return none
        at, weight, boosted = np.searchsorted(codes, a["code"].to_numpy()), a["weight"].to_numpy(), a["boosted"].to_numpy().astype(np.int8)
        users, starts = np.unique(a["user_id"].to_numpy(), return_index=True)
        ends, out, i = np.append(starts[1:], len(a)), [], 0
        while i < len(users):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + HELD // size, side="right")))
            rows, firsts = slice(starts[i], ends[j - 1]), starts[i:j] - starts[i]
            # a column is summed in the order of its rows, so news with equal entities have equal scores
            near = np.add.reduceat(weight[rows, None] * table[at[rows]], firsts, axis=0)
            out.extend(near + boost * np.add.reduceat((boosted[rows, None] * holds[at[rows]]).astype(np.int32), firsts, axis=0))
            i = j
        return pd.DataFrame({"user_id": users, "scores": out})

    asked = query.filter("user_id IS NOT NULL")
    block = F.pmod(F.xxhash64("user_id"), F.lit(-(-max(asked.agg(F.count_distinct("user_id")).first()[0], 1) // USERS))).alias("block")
    boosted = F.col("type") == "stock"
    boosted = F.coalesce(boosted & (F.col("frequency") > 1), F.lit(False)) if "frequency" in query.columns else boosted
    asked = asked.select(block, "user_id", code, F.col("weight").cast("double").alias("weight"), boosted.alias("boosted"))
    needed = asked.select(F.col("block").alias("part"), F.col("code").alias("named")).distinct().join(profiles.withColumnRenamed("code", "named"), "named")
    kind = query.schema["user_id"].dataType.simpleString()
    return asked.groupBy("block").cogroup(needed.groupBy("part")).applyInPandas(scored, f"user_id {kind}, scores array<double>")
