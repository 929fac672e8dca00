"""Behaviour metrics, snapshots and posteriors from serves and interactions (2.D).

Time windows are half open unless said otherwise. Measures use the client's time where
there is one; a row belongs to a window by the server's time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PATHS = ("A1", "A2", "B", "C")
#: Arms of the bandit by path.
ARMS = {"A1": "onboarding", "A2": "behavior", "B": "breaking", "C": "popular"}
LAST_POSITION = 2147483647
KEYS = ["request_id", "user_id", "news_id"]
COUNTS = ["impression_count", "click_count", "dwell_5s_count", "dwell_30s_count", "dwell_event_count"]


def _within(column: str, start: str, end: str):
    return (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz"))


def _seconds(later, earlier):
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def explode_served_items(serves: DataFrame, start: str, end: str) -> DataFrame:
    """One row per served item with a numeric news_id and a known path; position may be null."""
    item = F.explode(F.from_json("served_items", "array<struct<news_id: string, path: string, position: string>>"))
    rows = serves.filter(_within("created_at", start, end) & F.col("request_id").isNotNull()).select("id", "request_id", "user_id", item.alias("item"))
    rows = rows.filter(F.col("item.news_id").rlike("^[0-9]+$") & F.col("item.path").isin(*PATHS))
    position = F.expr("try_cast(nullif(item.position, '') as int)")
    return rows.select("request_id", "user_id", F.col("item.news_id").cast("long").alias("news_id"), F.col("item.path").alias("path"), position.alias("position"), "id")


def dedup_impressions(items: DataFrame, by_user: bool = False) -> DataFrame:
    """D2, and D2u with ``by_user``: the first item of a request and news (and user), by position, then id, then path."""
    keys = ["request_id", *(["user_id"] if by_user else []), "news_id"]
    order = W.partitionBy(*keys).orderBy(F.coalesce("position", F.lit(LAST_POSITION)), "id", "path")
    rows = items.filter(F.col("user_id").isNotNull()) if by_user else items
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("request_id", "user_id", "news_id", "path")


def open_events(interactions: DataFrame, start: str, end: str) -> DataFrame:
    """D3: when a user first opened a news in a session."""
    rows = interactions.filter((F.col("event_type") == "content_open") & _within("event_ts_server", start, end) & F.col("request_id").isNotNull() & F.col("news_id").isNotNull())
    return rows.groupBy(*KEYS, "content_session_id").agg(F.min(F.coalesce("event_ts_client", "event_ts_server")).alias("open_ts"))


def click_metrics(opens: DataFrame) -> DataFrame:
    """One click for each request, user and news."""
    return opens.select(*KEYS).distinct().withColumn("click_count", F.lit(1).cast("long"))


def leave_events(interactions: DataFrame, start: str, end: str, grace_hours: int = 1) -> DataFrame:
    """The first leave of each session, up to the grace after the window."""
    upto = F.lit(end).cast("timestamp_ntz") + F.make_interval(hours=F.lit(grace_hours))
    rows = interactions.filter((F.col("event_type") == "content_leave") & (F.col("event_ts_server") >= F.lit(start).cast("timestamp_ntz")) & (F.col("event_ts_server") < upto))
    return rows.groupBy("content_session_id").agg(F.min(F.coalesce("event_ts_client", "event_ts_server")).alias("leave_ts"))


def dwell_sessions(opens: DataFrame, leaves: DataFrame) -> DataFrame:
    """Seconds between open and leave; leaves before the open don't count."""
    joined = opens.join(leaves, "content_session_id").filter("leave_ts >= open_ts")
    return joined.select(*KEYS, "content_session_id", F.greatest(_seconds(F.col("leave_ts"), F.col("open_ts")), F.lit(0.0)).alias("dwell_seconds"))


def dwell_metrics(sessions: DataFrame) -> DataFrame:
    """Dwells of each request, user and news."""
    return sessions.groupBy(*KEYS).agg(
        F.count("*").alias("dwell_event_count"), F.count_if(F.col("dwell_seconds") >= 5).alias("dwell_5s_count"),
        F.count_if(F.col("dwell_seconds") >= 30).alias("dwell_30s_count"), F.sum(F.log1p("dwell_seconds")).alias("sum_log_dwell_time"),
    )


def path_metrics(impressions: DataFrame, clicks: DataFrame, dwells: DataFrame, start: str, end: str) -> DataFrame:
    """Impressions, clicks and dwells by bucket, news and path."""
    joined = impressions.join(clicks, KEYS, "left").join(dwells, KEYS, "left")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    grouped = joined.groupBy("news_id", "path").agg(
        F.count("*").alias("impression_count"), *[total(c) for c in COUNTS[1:]], F.coalesce(F.sum("sum_log_dwell_time"), F.lit(0.0)).alias("sum_log_dwell_time")
    )
    return grouped.select(F.lit(start).cast("timestamp_ntz").alias("bucket_start"), F.lit(end).cast("timestamp_ntz").alias("bucket_end"), "news_id", "path", *COUNTS, "sum_log_dwell_time")


def with_total(metrics: DataFrame) -> DataFrame:
    """Also a row TOTAL for each news."""
    total = metrics.groupBy("bucket_start", "bucket_end", "news_id").agg(*[F.sum(c).alias(c) for c in [*COUNTS, "sum_log_dwell_time"]])
    return metrics.unionByName(total.withColumn("path", F.lit("TOTAL")).select(metrics.columns))


def hourly_path_metrics(serves: DataFrame, interactions: DataFrame, start: str, end: str) -> DataFrame:
    """D1 to D9 for one window."""
    opens = open_events(interactions, start, end)
    dwells = dwell_metrics(dwell_sessions(opens, leave_events(interactions, start, end)))
    return with_total(path_metrics(dedup_impressions(explode_served_items(serves, start, end)), click_metrics(opens), dwells, start, end))


ACTIVITY = ("content_open", "content_leave", "content_heartbeat")


def changed_users(interactions: DataFrame, start: str, end: str) -> DataFrame:
    """Users that were active in the window."""
    return interactions.filter(F.col("event_type").isin(*ACTIVITY) & _within("event_ts_server", start, end) & F.col("user_id").isNotNull()).select("user_id").distinct()


def user_opens(interactions: DataFrame, users: DataFrame) -> DataFrame:
    """The first open of each user, news and session, over all time."""
    rows = interactions.filter((F.col("event_type") == "content_open") & F.col("content_session_id").isNotNull() & F.col("news_id").isNotNull())
    rows = rows.join(users, "user_id", "left_semi")
    return rows.groupBy("user_id", "news_id", "content_session_id").agg(F.min(F.coalesce("event_ts_client", "event_ts_server")).alias("view_ts"))


def session_activity(interactions: DataFrame, users: DataFrame, snapshot_at: str) -> DataFrame:
    """The last event of each user and session up to the snapshot."""
    at = F.coalesce("event_ts_client", "event_ts_server")
    rows = interactions.filter(F.col("event_type").isin(*ACTIVITY) & (at <= F.lit(snapshot_at).cast("timestamp_ntz")) & F.col("content_session_id").isNotNull())
    return rows.join(users, "user_id", "left_semi").groupBy("user_id", "content_session_id").agg(F.max(at).alias("latest_event_ts"))


def qualified_sessions(opens: DataFrame, activity: DataFrame, min_dwell: float = 5) -> DataFrame:
    """Sessions of at least ``min_dwell`` seconds; the action's time is the last event's."""
    joined = opens.join(activity, ["user_id", "content_session_id"]).filter("latest_event_ts >= view_ts")
    seconds = _seconds(F.col("latest_event_ts"), F.col("view_ts"))
    return joined.select("user_id", "news_id", F.col("latest_event_ts").alias("action_ts"), seconds.alias("dwell_seconds")).filter(F.col("dwell_seconds") >= min_dwell)


def session_entities(sessions: DataFrame, news_keyword: DataFrame, news_stock: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
    """Adds the sorted ids of each news' keywords and stocks; they are gathered by news before the join, for the sessions' news alone.
    ``keep`` stores a frame that several steps read."""
    sessions = keep(sessions)
    wanted = keep(sessions.select("news_id").distinct())
    news_keyword, news_stock = (rows.join(wanted, "news_id", "left_semi") for rows in (news_keyword, news_stock))
    keywords = news_keyword.groupBy("news_id").agg(F.sort_array(F.collect_set("keyword")).alias("keyword_ids"))
    stocks = news_stock.groupBy("news_id").agg(F.sort_array(F.collect_set("stock_id")).alias("stock_ids"))
    none = lambda c, frame: F.coalesce(F.col(c), F.array().cast(frame.schema[c].dataType)).alias(c)
    joined = sessions.join(keywords, "news_id", "left").join(stocks, "news_id", "left")
    return joined.select(*sessions.columns, none("keyword_ids", keywords), none("stock_ids", stocks))


def ranked_actions(sessions: DataFrame, per_user: int = 20) -> DataFrame:
    """The latest actions of each user."""
    order = W.partitionBy("user_id").orderBy(F.desc("action_ts"), F.desc("news_id"), F.desc("dwell_seconds"))
    return sessions.withColumn("row_num", F.row_number().over(order)).filter(F.col("row_num") <= per_user)


def a2_items(actions: DataFrame, users: DataFrame, snapshot_at: str) -> DataFrame:
    """(user_id, items, snapshot_at): a JSON array of actions in order; [] for users without any."""
    item = F.struct("row_num", "news_id", F.date_format("action_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "dwell_seconds", "keyword_ids", "stock_ids")
    listed = actions.groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("listed"))
    items = F.to_json(F.transform("listed", lambda x: x.dropFields("row_num")))
    return users.join(listed, "user_id", "left").select("user_id", F.coalesce(items, F.lit("[]")).alias("items"), F.lit(snapshot_at).cast("timestamp_ntz").alias("snapshot_at"))


def a2_snapshot(interactions: DataFrame, news_keyword: DataFrame, news_stock: DataFrame, start: str, end: str, per_user: int = 20, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
    """D11 to D17 for the users of one window, as of its end."""
    users = changed_users(interactions, start, end)
    sessions = qualified_sessions(user_opens(interactions, users), session_activity(interactions, users, end))
    return a2_items(ranked_actions(session_entities(sessions, news_keyword, news_stock, keep), per_user), users, end)


def recent_actions(snapshot: DataFrame, limit: int) -> DataFrame:
    """Reads items back, in order; items without news_id or timestamp are left out."""
    items = F.from_json("items", "array<struct<news_id: long, timestamp: string, dwell_seconds: double, keyword_ids: array<string>, stock_ids: array<bigint>>>")
    rows = snapshot.select("user_id", F.posexplode(items).alias("pos", "item")).filter(F.col("item.news_id").isNotNull() & F.col("item.timestamp").isNotNull())
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    return rows.filter(F.col("pos") < limit).select(
        "user_id", "pos", "item.news_id", F.expr("try_cast(rtrim('Z', item.timestamp) as timestamp_ntz)").alias("action_ts"), "item.dwell_seconds",
        none("item.keyword_ids", "string").alias("keyword_ids"), none("item.stock_ids", "bigint").alias("stock_ids"),
    )


def ctr_base(metrics: DataFrame, snapshot_at: str, hours: int = 72) -> DataFrame:
    """Impressions and clicks of each news over the personal paths, with buckets inside the lookback."""
    at = F.lit(snapshot_at).cast("timestamp_ntz")
    inside = (F.col("bucket_start") >= at - F.make_interval(hours=F.lit(hours))) & (F.col("bucket_end") <= at)
    rows = metrics.filter(F.col("path").isin("A1", "A2", "B") & inside).groupBy("news_id")
    return rows.agg(F.sum("impression_count").alias("impression_count"), F.sum("click_count").alias("click_count")).filter("impression_count > 0")


def global_prior_ctr(base: DataFrame) -> DataFrame:
    """Clicks over impressions of all news; 0 without any."""
    return base.agg(F.coalesce(F.sum("click_count") / F.nullif(F.sum("impression_count"), F.lit(0)), F.lit(0.0)).alias("prior_ctr"))


def smoothed_ctr(base: DataFrame, prior: DataFrame, prior_impressions: float = 20) -> DataFrame:
    """The ratio pulled to the prior, which is one row."""
    score = (F.col("click_count") + F.col("prior_ctr") * prior_impressions) / (F.col("impression_count") + prior_impressions)
    return base.crossJoin(F.broadcast(prior)).withColumn("score", score).drop("prior_ctr")


def popular_top(scored: DataFrame, snapshot_at: str, limit: int = 500) -> DataFrame:
    """(snapshot_at, news_ids): the best news in order, an empty array without any."""
    top = scored.orderBy(F.desc("score"), F.desc("click_count"), F.desc("impression_count"), F.desc("news_id")).limit(limit)
    ordered = F.reverse(F.sort_array(F.collect_list(F.struct("score", "click_count", "impression_count", "news_id"))))
    return top.agg(ordered.alias("rows")).select(F.lit(snapshot_at).cast("timestamp_ntz").alias("snapshot_at"), F.col("rows.news_id").alias("news_ids"))


def global_posteriors(metrics: DataFrame, window_end: str, hours: int = 72) -> DataFrame:
    """Rewards (dwells of 5 s) and impressions by path."""
    at = F.lit(window_end).cast("timestamp_ntz")
    inside = (F.col("bucket_start") >= at - F.make_interval(hours=F.lit(hours))) & (F.col("bucket_end") <= at) & F.col("path").isin(*PATHS)
    return metrics.filter(inside).groupBy("path").agg(F.sum("dwell_5s_count").alias("reward_count"), F.sum("impression_count").alias("impression_count"))


def dwell_rewards(interactions: DataFrame, start: str, end: str, threshold: float = 5) -> DataFrame:
    """Requests, users and news with a dwell of at least the threshold."""
    sessions = dwell_sessions(open_events(interactions, start, end), leave_events(interactions, start, end))
    return sessions.filter(F.col("dwell_seconds") >= threshold).select(*KEYS).distinct()


def user_posteriors(impressions: DataFrame, rewards: DataFrame) -> DataFrame:
    """Rewards and impressions by user and path."""
    marked = rewards.withColumn("rewarded", F.lit(1))
    return impressions.join(marked, KEYS, "left").groupBy("user_id", "path").agg(F.count("rewarded").alias("reward_count"), F.count("*").alias("impression_count"))


def to_posterior(rows: DataFrame, window_end: str, hours: int = 72) -> DataFrame:
    """alpha = rewards, beta = the impressions without; paths become arms, unknown ones are dropped."""
    arm = F.create_map(*[F.lit(x) for pair in ARMS.items() for x in pair])[F.col("path")]
    at = F.lit(window_end).cast("timestamp_ntz")
    rows = rows.withColumn("path", arm).filter(F.col("path").isNotNull())
    return rows.withColumns({
        "alpha": F.col("reward_count").cast("double"), "beta": F.greatest(F.col("impression_count") - F.col("reward_count"), F.lit(0)).cast("double"),
        "window_start": at - F.make_interval(hours=F.lit(hours)), "window_end": at,
    })


def update_bandit_state(serves: DataFrame, interactions: DataFrame, metrics: DataFrame, window_end: str, hours: int = 72, threshold: float = 5) -> DataFrame:
    """Rows of scope global and user; global ones have no user."""
    start = F.expr(f"timestamp_ntz'{window_end}' - interval {hours} hours")
    start = metrics.sparkSession.range(1).select(start.cast("string")).first()[0]
    overall = to_posterior(global_posteriors(metrics, window_end, hours), window_end, hours).select(F.lit("global").alias("scope"), F.lit(None).cast("long").alias("user_id"), "path", "alpha", "beta", "reward_count", "impression_count", "window_end")
    shown = dedup_impressions(explode_served_items(serves, start, window_end), by_user=True)
    users = to_posterior(user_posteriors(shown, dwell_rewards(interactions, start, window_end, threshold)), window_end, hours)
    return overall.unionByName(users.withColumn("scope", F.lit("user")).select(overall.columns))


def bandit_lookup(state: DataFrame, users: DataFrame, paths: list[str]) -> DataFrame:
    """(user_id, path, alpha, beta) of users for the paths, and of all users together with a null user; nulls are 0."""
    arms = state.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    asked = users.select("user_id").distinct().unionByName(users.sparkSession.createDataFrame([(None,)], "user_id long")).crossJoin(F.broadcast(arms))
    held = state.filter((F.col("scope") == "global") & F.col("user_id").isNull() | (F.col("scope") == "user") & F.col("user_id").isNotNull()).select(F.col("user_id").alias("u"), F.col("path").alias("p"), "alpha", "beta")
    joined = asked.join(held, F.col("user_id").eqNullSafe(F.col("u")) & (F.col("path") == F.col("p")), "left")
    return joined.select("user_id", "path", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("beta", F.lit(0.0)).alias("beta"))


def read_news(interactions: DataFrame, as_of: str, days: int = 30, limit: int = 1000, threshold: float = 5) -> DataFrame:
    """(user_id, news_id, open_ts, rank): news that a user read for at least the threshold, the latest opened first."""
    at = F.coalesce("event_ts_client", "event_ts_server")
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    rows = interactions.filter((F.col("event_ts_server") >= since) & F.col("content_session_id").isNotNull())
    opened = rows.filter("event_type = 'content_open' AND news_id IS NOT NULL").groupBy("user_id", "news_id", "content_session_id").agg(F.min(at).alias("open_ts"))
    left = rows.filter("event_type = 'content_leave'").groupBy("user_id", "content_session_id").agg(F.max(at).alias("leave_ts"))
    read = opened.join(left, ["user_id", "content_session_id"]).filter(_seconds(F.col("leave_ts"), F.col("open_ts")) >= threshold)
    latest = read.groupBy("user_id", "news_id").agg(F.max("open_ts").alias("open_ts"))
    return latest.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("open_ts"), F.desc("news_id")))).filter(F.col("rank") <= limit)


def recent_serves(serves: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """When and how often each news was served to each user in the last hours."""
    start = serves.sparkSession.range(1).select(F.expr(f"timestamp_ntz'{as_of}' - interval {hours} hours").cast("string")).first()[0]
    item = F.explode(F.from_json("served_items", "array<struct<news_id: string>>"))
    rows = serves.filter((F.col("created_at") >= F.lit(start).cast("timestamp_ntz")) & F.col("user_id").isNotNull()).select("user_id", "created_at", item.alias("item"))
    rows = rows.filter(F.col("item.news_id").rlike("^[0-9]+$"))
    return rows.groupBy("user_id", F.col("item.news_id").cast("long").alias("news_id")).agg(F.max("created_at").alias("last_served_at"), F.count("*").alias("serve_count"))


def request_count(serves: DataFrame) -> DataFrame:
    """Requests of each user."""
    return serves.groupBy("user_id").agg(F.count("*").alias("requests"))
