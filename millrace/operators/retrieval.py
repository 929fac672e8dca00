"""Candidates, scores and timelines for all users at once (2.E, 2.F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import hashed
from .pools import FETCHED, free_lists, numbered

PAIR_WEIGHTS = {("keyword", "keyword"): 1.0, ("stock", "stock"): 1.15}
MIXED_WEIGHT = 0.9


def onboarding_profile(stocks: DataFrame, keywords: DataFrame) -> DataFrame:
    """(user_id, stock_ids, keyword_ids), sorted, as texts; users with neither have no row."""
    s = stocks.groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("stock_id").cast("string"))).alias("stock_ids"))
    k = keywords.groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("keyword_id").cast("string"))).alias("keyword_ids"))
    none = F.array().cast("array<string>")
    return s.join(k, "user_id", "full_outer").select("user_id", F.coalesce("stock_ids", none).alias("stock_ids"), F.coalesce("keyword_ids", none).alias("keyword_ids"))


def recent_candidates(articles: DataFrame, users: DataFrame, exclude: DataFrame, as_of: str, limit: int, stale_minutes: int | None = None, blocked: list[str] = ()) -> DataFrame:
    """(user_id, news_id, pub_date, rank). The newest 4 * limit are taken first, then filtered for each user; fewer may stay."""
    pool = numbered(articles, F.desc("pub_date"), F.desc("news_id"), limit=FETCHED * limit)
    if stale_minutes is not None:
        pool = pool.filter(F.col("pub_date") >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(mins=F.lit(stale_minutes)))
    if blocked:
        pool = pool.filter(~F.col("domain").isin(list(blocked)))
    return free_lists(pool.select("news_id", "pub_date", "place"), users, exclude, limit).select("user_id", "news_id", "pub_date", (F.col("pos") + 1).alias("rank"))


def latest_ids(articles: DataFrame, users: DataFrame, exclude: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(user_id, news_id, pos): past the ``offset`` newest news, of the next 4 * limit the first ``limit`` that a user may see; fewer may stay."""
    pool = numbered(articles.select("news_id", "pub_date"), F.desc("pub_date"), F.desc("news_id"), limit=offset + FETCHED * limit)
    return free_lists(pool.filter(F.col("place") >= offset), users, exclude, limit).select("user_id", "news_id", F.col("pos").cast("long").alias("pos"))


def popular_from_snapshots(snapshots: DataFrame, articles: DataFrame, as_of: str, limit: int, stale_minutes: int = 180, latest: int = 5) -> DataFrame:
    """(news_id, rank, snapshot_at): the newest rank of each news in the latest snapshots; nothing where the best row is stale."""
    newest = snapshots.orderBy(F.desc("snapshot_at")).limit(latest)
    rows = newest.select("snapshot_at", F.posexplode("news_ids").alias("rank", "news_id"))
    last = F.row_number().over(W.partitionBy("news_id").orderBy(F.desc("snapshot_at"), "rank"))
    ranked = rows.withColumn("rn", last).filter("rn = 1").drop("rn").join(articles.select("news_id"), "news_id", "left_semi")
    best = ranked.orderBy("rank", F.desc("snapshot_at"), F.desc("news_id")).limit(1).select(F.col("snapshot_at").alias("best_at"))
    fresh = best.filter(F.col("best_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(mins=F.lit(stale_minutes)))
    return ranked.crossJoin(F.broadcast(fresh)).drop("best_at").orderBy("rank", F.desc("snapshot_at"), F.desc("news_id")).limit(limit)


def popular_fallback(articles: DataFrame, metrics: DataFrame, as_of: str, limit: int, hours: int | None = 72, metrics_as_of: str | None = None, days: int | None = 7) -> DataFrame:
    """E5: (news_id, ctr, pub_date): recent news by the click rate of the last days, then time.

    ``metrics_as_of`` is the moment the days go back from, where it isn't ``as_of``. Without ``hours`` all news
    up to ``as_of`` are ranked, without ``days`` by all metrics.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    recent, counted = articles.filter(F.col("pub_date") <= at), metrics.filter("path <> 'TOTAL'")
    if hours is not None:
        recent = recent.filter(F.col("pub_date") >= at - F.make_interval(hours=F.lit(hours)))
    if days is not None:
        counted = counted.filter(F.col("bucket_start") >= F.lit(metrics_as_of or as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))
    ctr = counted.groupBy("news_id").agg((F.sum("click_count") / F.nullif(F.sum("impression_count"), F.lit(0))).alias("ctr"))
    joined = recent.join(ctr, "news_id", "left").select("news_id", F.coalesce("ctr", F.lit(0.0)).alias("ctr"), "pub_date")
    return joined.orderBy(F.desc("ctr"), F.desc("pub_date"), F.desc("news_id")).limit(limit)


def popular_candidates(snapshot_rows: DataFrame, fallback: DataFrame, limit: int) -> DataFrame:
    """(news_id, part, place): the first 4 * limit of the snapshots; where they are under half the limit, the fallback fills up to 4 * limit.

    ``place`` counts from 0 over both and is the order in which they are shown; only the first ``limit`` are.
    """
    most = FETCHED * limit
    shown = snapshot_rows.orderBy("rank", F.desc("news_id")).limit(most).select("news_id", F.lit(0).alias("part"), F.col("rank").cast("double").alias("key"), F.lit(None).cast("timestamp_ntz").alias("pub_date"))
    have = shown.agg(F.count("*")).scalar()
    more = fallback.join(snapshot_rows.select("news_id"), "news_id", "left_anti").filter(have < limit // 2)
    both = shown.unionByName(more.select("news_id", F.lit(1).alias("part"), (-F.col("ctr")).alias("key"), F.col("pub_date").cast("timestamp_ntz").alias("pub_date")))
    return numbered(both, F.col("part"), F.col("key"), F.desc("pub_date"), F.desc("news_id"), limit=limit).select("news_id", "part", "place")


def news_entities(news_keyword: DataFrame, news_stock: DataFrame) -> DataFrame:
    """(news_id, type, id) of all entities."""
    return news_keyword.select("news_id", F.lit("keyword").alias("type"), F.col("keyword").cast("string").alias("id")).unionByName(news_stock.select("news_id", F.lit("stock").alias("type"), F.col("stock_id").cast("string").alias("id"))).distinct()


def entity_vectors(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entities with their vectors; those without, or with an empty one, are dropped."""
    held = vectors.filter(F.size("vector") > 0).select(F.lower("type").alias("type"), "id", "vector")
    return entities.join(held, ["type", "id"])


def onboarding_query(profile: DataFrame) -> DataFrame:
    """(user_id, type, id, weight): every entity of the profile with weight 1."""
    stock, keyword = (profile.select("user_id", F.lit(t).alias("type"), F.explode(c).alias("id")) for t, c in (("stock", "stock_ids"), ("keyword", "keyword_ids")))
    return stock.unionByName(keyword).withColumn("weight", F.lit(1.0))


def time_decay(ts: Column, now: Column, half_life_hours: float) -> Column:
    """Halves every half life; 1 without a time, and for the future."""
    age = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9, F.lit(0.0))
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) * age / F.greatest(F.lit(half_life_hours), F.lit(1.0))), F.lit(1.0))


def behavior_query(actions: DataFrame, as_of: str, half_life_hours: float = 24) -> DataFrame:
    """(user_id, type, id, weight, frequency) from recent actions; users need two actions and two entities."""
    decay = time_decay(F.col("action_ts"), F.lit(as_of).cast("timestamp_ntz"), half_life_hours)
    enough = actions.groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 2").select("user_id")
    rows = actions.withColumn("decay", decay)
    each = rows.select("user_id", "decay", F.lit("keyword").alias("type"), F.explode("keyword_ids").alias("id")).unionByName(rows.select("user_id", "decay", F.lit("stock").alias("type"), F.explode(F.transform("stock_ids", lambda x: x.cast("string"))).alias("id")))
    grouped = each.join(enough, "user_id", "left_semi").groupBy("user_id", "type", "id").agg(
        F.count("*").alias("frequency"), (F.log1p(F.count("*").cast("double")) + 0.7 * F.sum("decay") + 0.3 * F.max("decay")).alias("weight")
    )
    two = grouped.groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 2").select("user_id")
    return grouped.join(two, "user_id", "left_semi")


def cosine(left: Column, right: Column) -> Column:
    """0 for vectors of other lengths, without numbers or of length 0."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    product = norm(left) * norm(right)
    return F.when((F.size(left) != F.size(right)) | (F.size(left) == 0) | (product == 0), 0.0).otherwise(dot / product)


def pair_weight(left: Column, right: Column) -> Column:
    """E13."""
    out = F
    for (a, b), w in PAIR_WEIGHTS.items():
        out = out.when((left == a) & (right == b), w)
    return out.otherwise(MIXED_WEIGHT)


def entity_similarity(query: DataFrame, held: DataFrame, candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q_type, q_id, type, id, sim): weighted similarity of the entities that meet through a user; only positive ones.

    ``query`` has (user_id, type, id), ``held`` (news_id, type, id), ``candidates`` (user_id,
    news_id). A pair of entities is found once however many users it meets through, and no
    pair is made that no user has. Entities without a vector have no pair.
    """
    known = vectors.filter(F.size("vector") > 0).select(F.lower("type").alias("type"), "id", "vector").dropDuplicates(["type", "id"])
    mine = candidates.select("user_id", "news_id").join(held, "news_id").select("user_id", "type", "id").distinct()
    asked = query.select("user_id", F.col("type").alias("q_type"), F.col("id").alias("q_id"))
    met = asked.join(mine, "user_id").select("q_type", "q_id", "type", "id").distinct()
    both = met.join(known, ["type", "id"]).join(known.select(F.col("type").alias("q_type"), F.col("id").alias("q_id"), F.col("vector").alias("q_vector")), ["q_type", "q_id"])
    sim = F.greatest(cosine(F.col("q_vector"), F.col("vector")), F.lit(0.0)) * pair_weight(F.col("q_type"), F.col("type"))
    return both.select("q_type", "q_id", "type", "id", sim.alias("sim")).filter("sim > 0")


def max_sim(query: DataFrame, similarity: DataFrame, entities: DataFrame, candidates: DataFrame, boost: float = 0.0, boosted: DataFrame | None = None) -> DataFrame:
    """(user_id, news_id, score): for each query entity its best entity of the news, weighted and summed, plus the boost of shared stocks.

    Candidates without entities score 0 and get no boost.
    """
    near = query.select("user_id", F.col("type").alias("q_type"), F.col("id").alias("q_id"), "weight").join(similarity, ["q_type", "q_id"])
    held = candidates.select("user_id", "news_id").join(entities, "news_id")
    best = held.join(near, ["user_id", "type", "id"]).groupBy("user_id", "news_id", "q_type", "q_id").agg(F.max("weight").alias("weight"), F.max("sim").alias("sim"))
    score = best.groupBy("user_id", "news_id").agg(F.sum(F.col("weight") * F.col("sim")).alias("score"))
    out = candidates.join(score, ["user_id", "news_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if boosted is not None:
        hits = held.filter("type = 'stock'").join(boosted, ["user_id", "id"]).groupBy("user_id", "news_id").agg(F.count_distinct("id").alias("hits"))
        out = out.join(hits, ["user_id", "news_id"], "left").withColumn("score", F.col("score") + boost * F.coalesce("hits", F.lit(0))).drop("hits")
    return out


def rank_candidates(scored: DataFrame, limit: int, least: float | None = None) -> DataFrame:
    """The best of each user by score, time and id; ``least`` drops low scores after the limit."""
    order = W.partitionBy("user_id").orderBy(F.desc("score"), F.desc("pub_date"), F.desc("news_id"))
    out = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return out if least is None else out.filter(F.col("score") >= least)


def with_vectors(query: DataFrame, candidates: DataFrame, entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """The users of whom any entity asked for, or of any candidate, has a vector; the others' candidates are not scored."""
    known = vectors.filter(F.size("vector") > 0).select(F.lower("type").alias("type"), "id").distinct()
    asked = query.select("user_id", "type", "id").join(known, ["type", "id"], "left_semi").select("user_id")
    shown = entities.join(known, ["type", "id"], "left_semi").select("news_id").distinct()
    offered = candidates.join(query.select("user_id").distinct(), "user_id", "left_semi").join(shown, "news_id", "left_semi").select("user_id")
    return asked.unionByName(offered).distinct()


def onboarding_path(scored: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """The best of users with a profile; others have none."""
    return rank_candidates(scored.join(query.select("user_id").distinct(), "user_id", "left_semi"), limit)


def behavior_path(scored: DataFrame, query: DataFrame, limit: int, least: float) -> DataFrame:
    """The best of users with a query, low scores dropped after the limit; of others the first ``limit``, newest first, without a score."""
    asked = query.select("user_id").distinct()
    ranked = rank_candidates(scored.join(asked, "user_id", "left_semi"), limit, least)
    plain = scored.join(asked, "user_id", "left_anti").withColumn("score", F.lit(None).cast("double"))
    return ranked.unionByName(rank_candidates(plain, limit))


def suppression(acted: DataFrame, read: DataFrame, served: DataFrame, as_of: str, recent_seconds: int = 3600, floor: float = 0.2, step: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(excluded pairs, multipliers): acted on, read or just served news; others served are marked down."""
    at = F.lit(as_of).cast("timestamp_ntz")
    just = served.filter(F.col("last_served_at") >= at - F.make_interval(secs=F.lit(recent_seconds)))
    excluded = acted.select("user_id", "news_id").unionByName(read.select("user_id", "news_id")).unionByName(just.select("user_id", "news_id")).distinct()
    return excluded, served.select("user_id", "news_id", F.greatest(F.lit(floor), 1 - step * F.col("serve_count")).alias("multiplier"))


def apply_exposure_penalty(ranked: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Ranks anew by (score, or else places from the end) times the multiplier; equal keys keep their order."""
    total = F.count("*").over(W.partitionBy("user_id"))
    key = F.coalesce("score", (total - F.col("rank") + 1).cast("double")) * F.coalesce("multiplier", F.lit(1.0))
    rows = ranked.join(multipliers, ["user_id", "news_id"], "left").withColumn("key", key)
    order = W.partitionBy("user_id").orderBy(F.desc("key"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order)).drop("multiplier")


def user_state(actions: Column, source: Column) -> Column:
    """Warm with two recent actions; a source's ending goes before."""
    return F.when(source.endswith("_warm"), "warm").when(source.endswith("_cold"), "cold").when(actions >= 2, "warm").otherwise("cold")


def in_blocks(queries: DataFrame, query: str, vectors: DataFrame, key: str, block: int):
    """Both sides grouped by (qb, vb) for a cogroup: every block of about ``block`` queries meets every block of vectors."""
    m, n = (max(1, -(-rows.count() // block)) for rows in (queries, vectors))

    def dealt(rows, column, own, parts, other, others):
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return rows.withColumn(own, F.pmod(F.xxhash64(column), F.lit(parts))).withColumn(other, each).groupBy("qb", "vb")

    return dealt(queries, query, "qb", m, "vb", n), dealt(vectors, key, "vb", n, "qb", m)


def unit_rows(vectors):
    """A float64 matrix of the vectors, each divided by its length; vectors of length 0 stay 0."""
    import numpy as np

    matrix = np.stack(list(vectors)).astype(np.float64)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def top_k_similar(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048, same: bool = True) -> DataFrame:
    """(query, id, rank, similarity): exact nearest vectors by cosine, ties by id; with ``same`` the query itself is left out.

    A task multiplies one block of queries with one of vectors and keeps the best k of each query.
    """
    import numpy as np
    import pandas as pd

    q = queries.select(F.col("id").alias("query"), F.col("vector").alias("q_vector"))
    left, right = in_blocks(q, "query", vectors.select("id", "vector"), "id", block)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "id": [], "similarity": []})
        sim, ids = unit_rows(a["q_vector"]) @ unit_rows(b["vector"]).T, b["id"].to_numpy()
        if same:
            sim[a["query"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        out = []
        for i, query in enumerate(a["query"]):
            order = np.lexsort((ids, -np.round(sim[i], 9)))[:k]
            out.append(pd.DataFrame({"query": query, "id": ids[order], "similarity": sim[i][order]}))
        return pd.concat(out)

    kind = vectors.schema["id"].dataType.simpleString()
    found = left.cogroup(right).applyInPandas(best, f"query {queries.schema['id'].dataType.simpleString()}, id {kind}, similarity double").filter("similarity > double('-infinity')")
    order = W.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def context_override(built: DataFrame, overrides: DataFrame, column: str) -> DataFrame:
    """An override replaces the column, nulls too, and names its source."""
    right = overrides.select("user_id", F.col(column).alias("o"), F.lit(True).alias("hit"))
    hit = F.col("hit").isNotNull()
    joined = built.join(right, "user_id", "left")
    return joined.withColumns({column: F.when(hit, F.col("o")).otherwise(F.col(column)), "source": F.when(hit, "debug_override").otherwise(F.col("source"))}).drop("o", "hit")


ARMS = ("onboarding", "behavior", "breaking", "popular")


def fixed_mix(candidates: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(user_id, pos, news_id, path): arms in turn give their weight's worth; a repeated news uses its turn up."""
    arm, weight = (F.create_map(*[F.lit(x) for i, p in enumerate(weights) for x in (p, v(i, p))])[F.col("path")] for v in (lambda i, p: i, lambda i, p: weights[p]))
    rows = candidates.withColumns({"arm": arm, "turn": F.floor(F.col("pos") / weight), "within": F.col("pos") % weight}).filter("arm IS NOT NULL")
    order = ["turn", "arm", "within"]
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("user_id", "news_id").orderBy(*order))).filter("rn = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(*order)) - 1).select("user_id", F.col("place").alias("pos"), "news_id", "path")


def breaking_guardrail(timeline: DataFrame, window: int = 10, least: int = 1) -> DataFrame:
    """brings late breaking news into the first places, each for the last other one there."""
    inside = F.col("pos") < window
    is_breaking = F.col("path") == "breaking"
    user = W.partitionBy("user_id")
    rows = timeline.withColumn("have", F.count_if(inside & is_breaking).over(user))
    late = F.row_number().over(W.partitionBy("user_id", inside, is_breaking).orderBy("pos"))
    last = F.row_number().over(W.partitionBy("user_id", inside, is_breaking).orderBy(F.desc("pos")))
    need = F.lit(least) - F.col("have")
    rows = rows.withColumns({"late": late, "last": last})
    ins = rows.filter(~inside & is_breaking & (F.col("late") <= need)).select("user_id", F.col("late").alias("j"), F.col("pos").alias("from_pos"))
    outs = rows.filter(inside & ~is_breaking & (F.col("last") <= need)).select("user_id", F.col("last").alias("j"), F.col("pos").alias("to_pos"))
    swaps = ins.join(outs, ["user_id", "j"])
    moves = swaps.select("user_id", F.col("from_pos").alias("pos"), F.col("to_pos").alias("new_pos")).unionByName(swaps.select("user_id", F.col("to_pos").alias("pos"), F.col("from_pos").alias("new_pos")))
    return timeline.join(moves, ["user_id", "pos"], "left").select("user_id", F.coalesce("new_pos", "pos").alias("pos"), "news_id", "path")


def arm_params(lookup: DataFrame, prior=(1.0, 199.0), w_global: float = 0.05, w_user: float = 1.0) -> DataFrame:
    """(user_id, path, alpha, beta): prior plus weighted global and own counts. ``lookup`` has a null user for all."""
    overall = lookup.filter("user_id IS NULL").select("path", F.col("alpha").alias("ga"), F.col("beta").alias("gb"))
    own = lookup.filter("user_id IS NOT NULL").join(overall, "path", "left")
    value = lambda p, g, u: F.lit(p) + w_global * F.coalesce(g, F.lit(0.0)) + w_user * F.col(u)
    return own.select("user_id", "path", value(prior[0], "ga", "alpha").alias("alpha"), value(prior[1], "gb", "beta").alias("beta"))


def uniform(*parts: Column | int) -> Column:
    """A number in (0, 1) that follows the parts alone."""
    mixed = F.xxhash64(*[(p if isinstance(p, Column) else F.lit(p)).cast("long") for p in parts])
    return (F.shiftrightunsigned(mixed, 11).cast("double") + 0.5) / float(1 << 53)


#: Draws that a gamma variate tries; each is accepted in over nine cases of ten, and the last resort is its mode.
TRIES = 24


def gamma_draw(shape: Column, *parts: Column | int) -> Column:
    """A gamma variate of the shape (over 0) from uniforms of the parts, by squeezed cubes of normal variates."""
    raised = F.when(shape < 1, shape + 1).otherwise(shape)
    d = raised - 1.0 / 3
    c = 1 / F.sqrt(9 * d)

    def tried(done: Column, i: Column) -> Column:
        u, v, w = (uniform(*parts, i, k) for k in range(3))
        x = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
        cube = F.pow(1 + c * x, F.lit(3.0))
        fits = (cube > 0) & (F.log(w) < 0.5 * x * x + d - d * cube + d * F.log(F.greatest(cube, F.lit(1e-300))))
        return F.coalesce(done, F.when(fits, d * cube))

    drawn = F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), tried), d)
    return F.when(shape < 1, drawn * F.pow(uniform(*parts, TRIES, 0), 1 / shape)).otherwise(drawn)


def thompson_mix(candidates: DataFrame, params: DataFrame, mode: str = "sample", seed: int = 7, batch: int = 20, least: int = 2) -> DataFrame:
    """(user_id, pos, news_id, path): slot by slot the arm of the highest draw; arms below ``least`` in a batch go first.

    Mode 'mean' takes alpha / (alpha + beta) for every draw, 'sample' a beta variate that
    follows seed, user, slot and arm. All slots of a user are a fold inside one row; its
    lists are bounded by the paths' limits. Users without parameters have 1 and 1.
    """
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("path") == arm, F.struct("pos", "news_id")))), lambda x: x["news_id"]).alias(arm) for arm in ARMS]
    rows = candidates.filter(F.col("path").isin(*ARMS)).groupBy("user_id").agg(*lists)
    of = [F.max(F.when(F.col("path") == arm, F.col(c))) for c in ("alpha", "beta") for arm in ARMS]
    given = params.groupBy("user_id").agg(F.array(*of[:4]).alias("a"), F.array(*of[4:]).alias("b"))
    rows = rows.join(given, "user_id", "left").select("user_id", F.array(*ARMS).alias("queues"), *[F.transform(F.coalesce(c, F.array_repeat(F.lit(1.0), 4)), lambda x: F.coalesce(x, F.lit(1.0))).alias(c) for c in ("a", "b")])
    arms = F.sequence(F.lit(0), F.lit(len(ARMS) - 1))
    zeros = F.array_repeat(F.lit(0), len(ARMS))

    def draw(slot: Column, i: Column) -> Column:
        a, b = F.get("a", i), F.get("b", i)
        if mode == "mean":
            return a / (a + b)
        x, y = (gamma_draw(F.greatest(v, F.lit(1e-6)), seed, F.col("user_id"), slot, i, k) for k, v in enumerate((a, b)))
        return x / F.greatest(x + y, F.lit(1e-300))

    def step(state: Column, slot: Column) -> Column:
        counts = F.when(slot % batch == 0, zeros).otherwise(state["counts"])
        open_ = F.filter(arms, lambda i: F.get(state["at"], i) < F.size(F.get("queues", i)))
        scored = F.transform(open_, lambda i: F.struct((draw(slot, i) + F.when(F.get(counts, i) < least, 1e6).otherwise(0.0)).alias("score"), (-i).alias("arm")))
        best = -F.array_max(scored)["arm"]
        # One element is chosen; the lambda binds it so that draws are made once.
        return F.element_at(F.transform(F.array(best), lambda arm: F.struct(
            F.transform(state["at"], lambda x, i: x + (i == arm).cast("int")).alias("at"),
            F.transform(counts, lambda x, i: x + (i == arm).cast("int")).alias("counts"),
            F.concat(state["out"], F.array(F.struct(F.get(F.get("queues", arm), F.get(state["at"], arm)).alias("news_id"), arm.alias("arm")))).alias("out"),
        )), 1)

    start = F.struct(zeros.alias("at"), zeros.alias("counts"), F.array().cast("array<struct<news_id:bigint,arm:int>>").alias("out"))
    total = F.aggregate("queues", F.lit(0), lambda n, x: n + F.size(x))
    slots = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    mixed = F.aggregate(slots, start, step)["out"]
    each = rows.select("user_id", F.posexplode(mixed).alias("pos", "x"))
    return each.select("user_id", F.col("pos").cast("long").alias("pos"), "x.news_id", F.get(F.array(*map(F.lit, ARMS)), F.col("x.arm")).alias("path"))


def arm_scores(params: DataFrame) -> DataFrame:
    """F5."""
    return params.select("user_id", "path", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("score"))


def mix_counts(timeline: DataFrame) -> DataFrame:
    """items of each path."""
    return timeline.groupBy("user_id", "path").agg(F.count("*").alias("items"))


def variant_slots(spec: str) -> list[str]:
    """F8: "name:weight,..." as slots; a missing weight is 1, a bad one skips the variant."""
    slots = []
    for part in spec.split(","):
        name, _, weight = (x.strip() for x in part.partition(":"))
        try:
            slots += [name] * max(int(weight or 1), 0) if name else []
        except ValueError:
            continue
    return slots


def assign_variant(requests: DataFrame, slots: list[str]) -> DataFrame:
    """adds ``variant``; requests from a user's sixth on take the slots in turn, for which only they count; an override wins.

    Without slots all recommend.
    """
    prior = F.count("*").over(W.partitionBy("user_id").orderBy("ts", "request_id").rowsBetween(W.unboundedPreceding, -1))
    rows = requests.withColumn("eligible", (prior >= 5) & F.col("override").isNull())
    turn = F.sum(F.col("eligible").cast("long")).over(W.partitionBy("user_id").orderBy("ts", "request_id"))
    slots = slots or ["recommend"]
    slot = F.element_at(F.array(*map(F.lit, slots)), ((turn - 1) % len(slots) + 1).cast("int"))
    return rows.withColumn("variant", F.when(F.col("override").isNotNull(), F.col("override")).when(F.col("eligible"), slot).otherwise("recommend"))


def random_timeline(pool: DataFrame, users: DataFrame, exclude: DataFrame, seed: int, articles: DataFrame, limit: int, drawn: int = 100) -> DataFrame:
    """of the bounded pool (news_id, place) each user's first ``drawn`` that aren't excluded, in an order of the user's own.

    The same columns as ``latest_timeline``; users with none get the newest ``limit`` news.
    """
    rows = free_lists(pool.select("news_id", "place"), users, exclude, drawn)
    order = W.partitionBy("user_id").orderBy(hashed(seed, F.col("user_id"), F.col("news_id")), "news_id")
    return _or_latest(rows.withColumn("pos", F.row_number().over(order) - 1), "random", articles, users, exclude, limit)


def latest_timeline(articles: DataFrame, users: DataFrame, exclude: DataFrame, limit: int) -> DataFrame:
    """(user_id, pos, news_id, path, fallback_reason): the newest news of each user."""
    rows = latest_ids(articles, users, exclude, limit)
    return rows.select("user_id", "pos", "news_id", F.lit("latest").alias("path"), F.lit(None).cast("string").alias("fallback_reason"))


def pool_timeline(pool: DataFrame, users: DataFrame, exclude: DataFrame, path: str, articles: DataFrame, limit: int, shown: int | None = None) -> DataFrame:
    """the bounded pool (news_id, place) for each user, less what is excluded; users with none left get the newest news.

    The same columns as ``latest_timeline``; the path of those users is 'latest' and the reason "<path>_pool_empty".
    """
    return _or_latest(free_lists(pool.select("news_id", "place"), users, exclude, shown or (1 << 30)), path, articles, users, exclude, limit)


def _or_latest(rows: DataFrame, path: str, articles: DataFrame, users: DataFrame, exclude: DataFrame, limit: int) -> DataFrame:
    found = rows.select("user_id", F.col("pos").cast("long").alias("pos"), "news_id", F.lit(path).alias("path"), F.lit(None).cast("string").alias("fallback_reason"))
    empty = users.select("user_id").join(rows.select("user_id").distinct(), "user_id", "left_anti")
    return found.unionByName(latest_timeline(articles, empty, exclude, limit).withColumn("fallback_reason", F.lit(f"{path}_pool_empty")))


def impression_rows(timeline: DataFrame, sessions: DataFrame) -> DataFrame:
    """the rows that are logged for one page of each session.

    ``sessions`` has user_id, request_id, offset, limit, batch_generation_id, experiment_id and
    variant. Ranks count from 1 over the whole timeline; a missing path is 'unknown'.
    """
    shown = timeline.join(sessions, "user_id").filter((F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + F.col("limit")))
    return shown.select(
        "request_id", F.col("request_id").alias("session_id"), "user_id", "news_id", (F.col("pos") + 1).alias("rank"),
        F.coalesce("path", F.lit("unknown")).alias("path"), "batch_generation_id", "experiment_id", "variant",
    )


def assemble_timeline(prefix: DataFrame, paths: DataFrame, mixed: DataFrame) -> DataFrame:
    """(user_id, pos, news_id, path): what was served (user_id, pos, news_id), then the mixed entries it lacks.

    ``paths`` (user_id, news_id, path) names where served news came from; others are 'unknown'.
    """
    served = prefix.join(paths.select("user_id", "news_id", "path").dropDuplicates(["user_id", "news_id"]), ["user_id", "news_id"], "left")
    return append_batch(served.select("user_id", "pos", "news_id", F.coalesce("path", F.lit("unknown")).alias("path")), mixed)


def append_batch(timeline: DataFrame, more: DataFrame) -> DataFrame:
    """the timeline with further entries behind it, those it has already left out."""
    last = timeline.groupBy("user_id").agg((F.max("pos") + 1).alias("shift"))
    new = more.join(timeline.select("user_id", "news_id"), ["user_id", "news_id"], "left_anti").join(last, "user_id", "left")
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("pos")) - 1 + F.coalesce("shift", F.lit(0))
    return timeline.select("user_id", "pos", "news_id", "path").unionByName(new.select("user_id", nth.alias("pos"), "news_id", "path"))


def page_slice(timeline: DataFrame, limit: int) -> DataFrame:
    """adds page, rank on the timeline from 1, and the next page's offset, null on the last."""
    total = F.count("*").over(W.partitionBy("user_id"))
    page = F.floor(F.col("pos") / limit)
    return timeline.withColumns({"page": page, "rank": F.col("pos") + 1, "next_offset": F.when((page + 1) * limit < total, (page + 1) * limit)})


def queue_remaining(candidates: DataFrame, served: DataFrame) -> DataFrame:
    """items of each path that weren't served."""
    return candidates.join(served.select("user_id", "news_id"), ["user_id", "news_id"], "left_anti").groupBy("user_id", "path").agg(F.count("*").alias("remaining"))


def request_rows(sessions: DataFrame, candidates: DataFrame, served: DataFrame) -> DataFrame:
    """the request log: ``sessions`` with how many candidates of each path are left (<path>_remaining).

    ``sessions`` has user_id and the request's own columns (offset, cache_status, mix_ratio
    and such), which stay; a user without candidates has 0 of each.
    """
    left = queue_remaining(candidates, served).groupBy("user_id").agg(*[F.sum(F.when(F.col("path") == p, F.col("remaining"))).alias(f"{p}_remaining") for p in ARMS])
    return sessions.join(left, "user_id", "left").na.fill(0, [f"{p}_remaining" for p in ARMS])
