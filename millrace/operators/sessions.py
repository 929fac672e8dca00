"""Sessions of all users at once (E2, E3, E6, E16 to E20, F12, F19): one row a user, its lists inside the row.

News that can be shown come from a few bounded pools; a user's lists are the pools' lists
less the user's exclusions, inside the user's row. Failures, signals and the reason of what
is served are columns of that row. Only candidates that are scored become rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pools import FETCHED, barred_bits, first, free, listed, numbered
from .retrieval import ARMS, breaking_guardrail, fixed_mix, thompson_mix
from .scores import pool_entities, pool_scores

#: Writes what several plans read, and reads it back.
Keep = Callable[[DataFrame], DataFrame]
# Reasons, and the failures that a session may carry.
REASONS = ("onboarding_failed", "behavior_failed", "breaking_failed", "popular_failed")
FAILURES = ("base_failed", *REASONS, "latest_failed", "lookup_failed")
# How many news of each path a turn of the fixed mix takes.
WEIGHTS = {"onboarding": 2, "behavior": 2, "breaking": 1, "popular": 1}


class Limits(NamedTuple):
    """The platform's defaults; ``page`` is a request's own limit, ``least`` a user's behaviour score."""

    onboarding: int = 50
    behavior: int = 50
    breaking: int = 30
    popular: int = 30
    page: int = 20
    page_most: int = 100
    base_hours: int = 72
    breaking_hours: int = 24
    stale_minutes: int = 1440
    replenish: int = 0
    least: float = 0.05

    @property
    def base(self) -> int:
        return FETCHED * max(self.onboarding, self.behavior)


class Pools(NamedTuple):
    """``universe`` (news_id, bit) and three bounded lists (news_id, bit, place, ...): newest, snapshots, fallback."""

    universe: DataFrame
    newest: DataFrame
    snapshots: DataFrame
    fallback: DataFrame


def pools(articles: DataFrame, snapshots: DataFrame, fallback: DataFrame, as_of: str, limits: Limits, keep: Keep) -> Pools:
    """The pools at a time. ``snapshots`` (news_id, rank) are E4's rows and ``fallback`` (news_id, ctr, pub_date) E5's, both bounded.

    The newest news have flags for the hours of the base pool and of breaking news.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    most = FETCHED * max(limits.base, limits.onboarding + limits.behavior + limits.breaking, limits.page_most)
    since = lambda unit, n: F.coalesce(F.col("pub_date") >= at - F.make_interval(**{unit: F.lit(n)}), F.lit(False))
    newest = numbered(articles.select("news_id", "pub_date"), F.desc("pub_date"), F.desc("news_id"), limit=most)
    newest = newest.withColumns({"recent": since("hours", limits.base_hours), "breaking": since("hours", min(limits.breaking_hours, limits.base_hours)), "fresh": since("mins", limits.stale_minutes)})
    by_rank = W.orderBy("rank", F.desc("news_id"))
    listed_snapshots = snapshots.select("news_id", (F.row_number().over(by_rank) - 1).cast("int").alias("place"))
    by_rate = W.orderBy(F.desc("ctr"), F.desc("pub_date"), F.desc("news_id"))
    listed_fallback = fallback.select("news_id", (F.row_number().over(by_rate) - 1).cast("int").alias("place"))
    three = [keep(x) for x in (newest, listed_snapshots, listed_fallback)]
    ids = three[0].select("news_id").unionByName(three[1].select("news_id")).unionByName(three[2].select("news_id")).distinct()
    universe = keep(ids.withColumn("bit", (F.row_number().over(W.orderBy("news_id")) - 1).cast("int")))
    return Pools(universe, *[x.join(F.broadcast(universe), "news_id") for x in three])


def bases(users: DataFrame, exclude: DataFrame, found: Pools) -> DataFrame:
    """(user_id, barred): what each user may not see of the pools; users are distinct. Lists are made from it where they are read."""
    return users.select("user_id").join(barred_bits(exclude, found.universe), "user_id", "left")


def recent(limits: Limits) -> Column:
    """The newest news of the base hours, as many as are fetched for a base pool."""
    return first(F.filter("newest", lambda x: x["recent"]), FETCHED * limits.base)


def base_pool(limits: Limits) -> Column:
    """The base pool of a user, from the row's newest and barred."""
    return first(F.filter(recent(limits), lambda x: free(x, F.col("barred"))), limits.base)


def best_scored(entries: Column, scores: str, limit: int, least: float | None = None) -> Column:
    """(news_id, score) of the best ``limit`` by score, time and id; low scores go after the limit. ``scores`` are by place."""
    rated = F.transform(entries, lambda x: F.struct(F.coalesce(F.get(F.col(scores), x["place"]), F.lit(0.0)).alias("score"), x["pub_date"].alias("pub_date"), x["news_id"].alias("news_id")))
    best = first(F.reverse(F.sort_array(rated)), limit)
    best = best if least is None else F.filter(best, lambda x: x["score"] >= least)
    return F.transform(best, lambda x: F.struct(x["news_id"].alias("news_id"), x["score"].alias("score")))


def unscored(entries: Column) -> Column:
    return F.transform(entries, lambda x: F.struct(x["news_id"].alias("news_id"), F.lit(None).cast("double").alias("score")))


def none() -> Column:
    return F.array().cast("array<struct<news_id:bigint,score:double>>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, not again for every element of a list inside it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ids(entries: Column) -> Column:
    return F.transform(entries, lambda x: x["news_id"])


def retrieved(rows: DataFrame, found: Pools, limits: Limits) -> DataFrame:
    """Adds the four lists (news_id, score), ``fallback_used`` and ``fallback_reason``.

    ``rows`` has a row for each user: barred, onboarding and behavior (arrays of
    (news_id, score), best first), insufficient, has_profile, has_actions, and a flag for
    each of FAILURES. Columns ``newest``, ``snapshots`` and ``fallback`` must not be among them.
    """
    c = F.col
    breaking_failed, popular_failed = c("breaking_failed"), c("popular_failed")
    failed = {"onboarding": c("onboarding_failed") | c("base_failed"), "behavior": (c("behavior_failed") | c("base_failed")) & c("has_actions"), "breaking": breaking_failed, "popular": popular_failed}
    rows = rows.withColumns({"newest": listed(found.newest), "snapshots": listed(found.snapshots), "fallback": listed(found.fallback)})
    rows = rows.withColumns({p: F.when(failed[p], none()).otherwise(F.coalesce(c(p), none())) for p in ("onboarding", "behavior")})
    # The newest of the breaking hours; what is too old goes after they are fetched.
    pool = F.filter(first(F.filter("newest", lambda x: x["breaking"]), FETCHED * limits.breaking), lambda x: x["fresh"] & free(x, c("barred")))
    rows = rows.withColumn("pool", pool)
    outside = lambda entries, *lists: bound(F.concat(*[ids(c(p)) for p in lists]), lambda taken: F.filter(entries, lambda x: ~F.array_contains(taken, x["news_id"])))
    rows = rows.withColumn("breaking", F.when(breaking_failed, none()).otherwise(unscored(first(outside("pool", "onboarding", "behavior"), limits.breaking))))
    apart = lambda name: F.filter(outside(name, "onboarding", "behavior", "breaking"), lambda x: free(x, c("barred")))
    rows = rows.withColumn("shown", ids(first(apart("snapshots"), FETCHED * limits.popular)))
    more = bound(c("shown"), lambda shown: F.filter(apart("fallback"), lambda x: ~F.array_contains(shown, x["news_id"])))
    more = ids(first(more, FETCHED * limits.popular - F.size("shown")))
    popular = F.when(F.size("shown") < limits.popular // 2, F.concat("shown", more)).otherwise(c("shown"))
    popular = F.transform(first(popular, limits.popular), lambda x: F.struct(x.alias("news_id"), F.lit(None).cast("double").alias("score")))
    rows = rows.withColumn("popular", F.when(popular_failed, none()).otherwise(popular))
    if limits.replenish > 0:
        rows = replenished(rows, limits)
    any_failed = failed["onboarding"] | failed["behavior"] | failed["breaking"] | failed["popular"]
    reason = F
    for path, why in zip(ARMS, REASONS):
        reason = reason.when(failed[path], why)
    reason = reason.when(c("insufficient") & c("has_actions"), "behavior_insufficient").otherwise(F.lit(None).cast("string"))
    primary, explored = F.size("onboarding") + F.size("behavior") > 0, F.size("breaking") + F.size("popular") > 0
    cold = ~c("has_profile") & ~c("has_actions") & ~any_failed
    newest = unscored(latest(limits.onboarding + limits.behavior + limits.breaking))
    return rows.withColumns({
        "fallback_used": F.when(primary, any_failed).when(explored, ~cold).otherwise(True),
        "fallback_reason": F.when(primary, reason).when(explored, F.when(~cold, "primary_failed_use_exploration")).when(c("latest_failed"), "db_failed").otherwise("retrieval_failed"),
        "onboarding": F.when(primary | explored, c("onboarding")).when(c("latest_failed"), none()).otherwise(newest),
    }).drop("pool", "shown", "newest", "snapshots", "fallback")


def latest(limit: int) -> Column:
    """The newest FETCHED * limit news, of which the first ``limit`` that are free; fewer may stay."""
    return first(F.filter(first(F.col("newest"), FETCHED * limit), lambda x: free(x, F.col("barred"))), limit)


def replenished(rows: DataFrame, limits: Limits) -> DataFrame:
    """Fills breaking up to ``replenish`` with the oldest of the fetched breaking news, which leave onboarding."""
    c, target = F.col, min(limits.replenish, limits.breaking)
    taken = F.concat(ids(c("behavior")), ids(c("breaking")))
    rows = rows.withColumn("supplement", ids(first(bound(taken, lambda taken: F.filter("pool", lambda x: ~F.array_contains(taken, x["news_id"]))), limits.breaking)))
    need = F.greatest(F.lit(target) - F.size("breaking"), F.lit(0))
    # The oldest are at the end; they stay in the order of the list.
    rows = rows.withColumn("added", F.when(need > 0, F.slice("supplement", F.greatest(F.size("supplement") - need + 1, F.lit(1)), F.greatest(need, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    more = F.transform("added", lambda x: F.struct(x.alias("news_id"), F.lit(None).cast("double").alias("score")))
    return rows.withColumns({
        "onboarding": bound(c("added"), lambda added: F.filter("onboarding", lambda x: ~F.array_contains(added, x["news_id"]))),
        "breaking": first(F.concat(c("breaking"), more), limits.breaking),
    }).drop("supplement", "added")


def penalised(entries: Column, multipliers: Column) -> Column:
    """The list by (score, or else places from the end) times the news' multiplier; equal keys keep their order."""
    total = F.size(entries)
    keyed = F.transform(entries, lambda x, i: F.struct(
        (-F.coalesce(x["score"], (total - i).cast("double")) * F.coalesce(F.try_element_at(multipliers, x["news_id"]), F.lit(1.0))).alias("key"), i.alias("i"), x["news_id"].alias("news_id"),
    ))
    return F.transform(F.array_sort(keyed), lambda x: x["news_id"])


def arm_lists(rows: DataFrame, limits: Limits, seed: int) -> DataFrame:
    """adds ``arm`` (news ids), ``arm_path`` and ``arm_reason`` for users of the variants latest, popular and random."""
    c, most = F.col, max(limits.page_most, limits.page)
    pool = first(F.filter("newest", lambda x: x["recent"]), FETCHED * max(limits.page_most, FETCHED * limits.page))
    drawn = first(F.filter(pool, lambda x: free(x, c("barred"))), max(limits.page_most, FETCHED * limits.page))
    number = lambda x: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c("user_id").cast("string"), x["news_id"].cast("string"))), 1, 15), 16, 10).cast("long")
    shuffled = F.transform(F.array_sort(F.transform(drawn, lambda x: F.struct(number(x).alias("key"), x["news_id"].alias("news_id")))), lambda x: x["news_id"])
    own = F.when(c("variant") == "latest", ids(latest(most))).when(c("variant") == "popular", c("popular_alone")).when(c("variant") == "random", shuffled)
    rows = rows.withColumn("arm", own)
    empty = (F.size("arm") == 0) & c("variant").isin("popular", "random")
    return rows.withColumns({
        "arm_path": F.when(empty, "latest").otherwise(c("variant")),
        "arm_reason": F.when(empty, F.concat("variant", F.lit("_pool_empty"))),
        "arm": F.when(empty, ids(latest(limits.page))).otherwise(c("arm")),
    })


def popular_alone(rows: DataFrame, found: Pools, limits: Limits) -> DataFrame:
    """Adds ``popular_alone``, the popular news of users whose other paths took nothing."""
    rows = rows.withColumns({"snapshots": listed(found.snapshots), "fallback": listed(found.fallback)})
    limit = max(limits.popular, limits.page)
    rows = rows.withColumn("shown", ids(first(F.filter("snapshots", lambda x: free(x, F.col("barred"))), FETCHED * limit)))
    more = bound(F.col("shown"), lambda shown: F.filter("fallback", lambda x: free(x, F.col("barred")) & ~F.array_contains(shown, x["news_id"])))
    more = ids(first(more, FETCHED * limit - F.size("shown")))
    both = F.when(F.size("shown") < limit // 2, F.concat("shown", more)).otherwise(F.col("shown"))
    return rows.withColumn("popular_alone", first(both, limit)).drop("snapshots", "fallback", "shown")


def path_rows(rows: DataFrame) -> DataFrame:
    """(user_id, path, pos, news_id) of the four lists."""
    lists = F.array(*[F.struct(F.lit(p).alias("path"), ids(F.col(p)).alias("news")) for p in ARMS])
    each = rows.select("user_id", F.explode(lists).alias("x")).select("user_id", "x.path", F.posexplode("x.news").alias("pos", "news_id"))
    return each.select("user_id", "path", F.col("pos").cast("long").alias("pos"), "news_id")


def outcomes(rows: DataFrame, timeline: DataFrame, found: Pools, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(sessions, timelines) of the variant recommend and of the others, from the mixed ``timeline``.

    Sessions are (user_id, variant, source, fallback_used, fallback_reason, items); a user
    whose timeline is empty gets the newest news, and where there are none a session without items.
    """
    c = F.col
    mixed = timeline.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "news_id", "path"))).alias("mix"))
    all_rows = rows.join(mixed, "user_id", "left").withColumn("newest", listed(found.newest))
    own = c("arm").isNull()
    nothing = own & c("mix").isNull()
    reason = F.coalesce("fallback_reason", F.when(c("lookup_failed"), "user_signal_lookup_failed").when(~c("has_profile"), "profile_missing"))
    entry = lambda news, path: F.struct(news.alias("news_id"), path.alias("path"))
    entries = (
        F.when(nothing, F.transform(latest(limits.page), lambda x: entry(x["news_id"], F.lit("latest"))))
        .when(own, F.transform("mix", lambda x: entry(x["news_id"], x["path"])))
        .otherwise(F.transform("arm", lambda x: entry(x, c("arm_path"))))
    )
    told = all_rows.select(
        "user_id", "variant",
        F.when(nothing, "latest_fallback").when(own, F.concat(F.lit("multipath_"), "state")).otherwise(F.concat(F.lit("ab_"), "variant", F.lit("_"), "state")).alias("source"),
        F.when(nothing, True).when(own, c("fallback_used")).otherwise(c("arm_reason").isNotNull()).alias("fallback_used"),
        F.when(nothing, F.coalesce(reason, F.lit("empty_result"))).when(own, reason).otherwise(c("arm_reason")).alias("fallback_reason"),
        entries.alias("entries"),
    )
    each = told.select("user_id", F.posexplode("entries").alias("pos", "x")).select("user_id", c("pos").cast("long").alias("pos"), "x.news_id", "x.path")
    return told.withColumn("items", F.size("entries").cast("long")).drop("entries"), each


class Signals(NamedTuple):
    """What is known of users: ``profiles`` (user_id), ``onboarding`` (user_id, type, id, weight), ``behavior`` (with
    frequency), ``actions`` (user_id, news_id), the recent ones."""

    profiles: DataFrame
    onboarding: DataFrame
    behavior: DataFrame
    actions: DataFrame


def scored_paths(rows: DataFrame, found: Pools, signals: Signals, entities: DataFrame, vectors: DataFrame, limits: Limits, keep: Keep, boosts: tuple[float, float] = (0.35, 0.2)) -> DataFrame:
    """Adds onboarding and behavior (news_id, score), insufficient, has_profile and has_actions to rows of ``bases``
    with their failures.

    Users without a profile query have no onboarding. Users with actions but without a query
    get the first news of their pool, unscored, and are insufficient. Where no entity asked for, or of the user's
    pool, has a vector nothing is scored (E15): onboarding is the first of the pool, behaviour empty.
    """
    c = F.col
    has = lambda frame, name: frame.select("user_id").distinct().withColumn(name, F.lit(True))
    seen = signals.actions.groupBy("user_id").agg(F.collect_set("news_id").alias("seen"))
    # no base pool reaches further than the one that ends last
    ends = rows.withColumn("newest", listed(found.newest)).select(F.array_max(F.transform(base_pool(limits), lambda x: x["place"])).alias("end"))
    size = (lambda end: 0 if end is None else end + 1)(ends.agg(F.max("end")).first()[0])
    held = keep(pool_entities(found.newest.filter(c("recent") & (c("place") < size)), entities, vectors))
    shown = held.agg(F.array_distinct(F.flatten(F.collect_list("held")))).scalar()
    scored = lambda query, boost, name: pool_scores(query, held, size, vectors, boost, keep).withColumnRenamed("scores", name)
    for frame in (has(signals.profiles, "has_profile"), has(signals.onboarding, "asked"), has(signals.behavior, "asked_behavior"), seen, scored(signals.onboarding, boosts[0], "first_scores"), scored(signals.behavior, boosts[1], "more_scores")):
        rows = rows.join(frame, "user_id", "left")
    no = F.lit(False)
    rows = rows.withColumn("has_actions", c("seen").isNotNull()).withColumns({n: F.coalesce(c(n), no) for n in ("has_profile", "asked", "asked_behavior")})
    rows = rows.withColumn("asked", c("asked") & ~c("base_failed") & ~c("onboarding_failed"))
    rows = rows.withColumn("asked_behavior", c("asked_behavior") & c("has_actions") & ~c("base_failed") & ~c("behavior_failed"))
    rows = rows.withColumns({"newest": listed(found.newest), "shown": shown}).withColumn("base", base_pool(limits))
    rated = lambda entries, scores: c(scores).isNotNull() | F.exists(entries, lambda x: F.array_contains("shown", x["place"]))
    onboarding = F.when(rated(c("base"), "first_scores"), best_scored(c("base"), "first_scores", limits.onboarding)).otherwise(unscored(first(c("base"), limits.onboarding)))
    rows = rows.withColumn("onboarding", F.when(c("asked"), onboarding).otherwise(none()))
    taken = F.concat(ids(c("onboarding")), F.coalesce("seen", F.array().cast("array<bigint>")))
    plain = c("has_actions") & ~c("asked_behavior") & ~c("base_failed") & ~c("behavior_failed")
    of = lambda left: F.when(plain, unscored(first(left, limits.behavior))).when(c("asked_behavior") & rated(left, "more_scores"), best_scored(left, "more_scores", limits.behavior, limits.least)).otherwise(none())
    behavior = bound(bound(taken, lambda taken: F.filter("base", lambda x: ~F.array_contains(taken, x["news_id"]))), of)
    rows = rows.withColumns({"behavior": behavior, "insufficient": plain})
    return keep(rows.drop("first_scores", "more_scores", "newest", "shown", "seen", "asked", "asked_behavior", "base"))


def with_failures(users: DataFrame, failures: DataFrame | None) -> DataFrame:
    """Users with a column for each of FAILURES; ``failures`` (user_id and any of them) may be absent, and null is none."""
    rows = users if failures is None else users.join(failures, "user_id", "left")
    return rows.withColumns({f: F.coalesce(F.col(f), F.lit(False)) if f in rows.columns else F.lit(False) for f in FAILURES})


def sessions(
    users: DataFrame, exclude: DataFrame, multipliers: DataFrame, signals: Signals, entities: DataFrame, vectors: DataFrame, found: Pools, keep: Keep,
    params: DataFrame | None = None, failures: DataFrame | None = None, limits: Limits = Limits(), allocator: str = "fixed", seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(sessions, timelines) of all users.

    ``users`` has user_id, variant (recommend, latest, popular, random or another, which
    recommends) and state (warm or cold); ``exclude`` user_id and news_id, ``multipliers``
    those of exposure. The allocator 'fixed' mixes by weights and brings breaking news into
    the first places; 'mean' and 'thompson' follow ``params`` (F3) and leave the order be.
    Users of the other variants are not scored. ``keep`` writes a frame and reads it back;
    each user's row and the candidates are used by several plans.
    """
    rows = bases(users, exclude, found).join(with_failures(users, failures), "user_id")
    arms = F.col("variant").isin("latest", "popular", "random") & F.col("variant").isNotNull()
    kept = keep(rows)
    own = retrieved(scored_paths(kept.filter(~F.coalesce(arms, F.lit(False))), found, signals, entities, vectors, limits, keep), found, limits)
    marked = multipliers.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("news_id", "multiplier"))).alias("multipliers"))
    own = own.join(marked, "user_id", "left")
    as_list = lambda p: F.transform(penalised(F.col(p), F.col("multipliers")), lambda x: F.struct(x.alias("news_id")))
    own = keep(own.withColumns({p: as_list(p) for p in ARMS}).drop("multipliers"))
    paths = path_rows(own)
    if allocator == "fixed":
        timeline = breaking_guardrail(fixed_mix(paths, WEIGHTS))
    else:
        timeline = thompson_mix(paths, params, "mean" if allocator == "mean" else "sample", seed)
    other = arm_lists(popular_alone(kept.filter(F.coalesce(arms, F.lit(False))), found, limits).withColumn("newest", listed(found.newest)), limits, seed)
    has_arm = other.select("user_id", "variant", "state", "barred", "arm", "arm_path", "arm_reason")
    nothing = {"fallback_used": F.lit(False), "fallback_reason": F.lit(None).cast("string"), "lookup_failed": F.lit(False), "has_profile": F.lit(False)}
    empty = {"arm": F.lit(None).cast("array<bigint>"), "arm_path": F.lit(None).cast("string"), "arm_reason": F.lit(None).cast("string")}
    both = own.withColumns(empty).select(*has_arm.columns, *nothing).unionByName(has_arm.withColumns(nothing))
    return outcomes(both, timeline, found, limits)
