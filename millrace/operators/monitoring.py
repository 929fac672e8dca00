"""Data-quality checks (2.I) and serving-log analytics (2.J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import clean_label, cursor_reason

REQUEST = """struct<timestamp: double, request_id: string, session_id: string, user_id: long, `limit`: int, `offset`: int, latency_ms: int,
cache_status: string, context_hash: string, context_present: boolean, fallback_used: boolean, fallback_reason: string,
prefetch_triggered: boolean, prefetch_status: string, prefetch_trigger_path: string, batch_generation_id: int,
onboarding_remaining: int, behavior_remaining: int, breaking_remaining: int, popular_remaining: int, mix_ratio: map<string, int>,
source: string, user_state: string, experiment_id: string, variant: string, returned: int, error: boolean>"""
IMPRESSION = """struct<timestamp: double, request_id: string, session_id: string, user_id: long, news_id: long, rank: int, path: string,
batch_generation_id: int, experiment_id: string, variant: string>"""


def schema_contract(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """(table, column) of required columns that tables lack."""
    rows = [(t, c) for t, columns in required.items() for c in columns if t not in tables or c not in tables[t].columns]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, column string")


def news_outputs(articles: DataFrame, crawled: DataFrame, refined: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row: newest times, counts, rows without their article, and whether news are stale."""
    a = articles.agg(F.max("pub_date").alias("max_pub_date"))
    c = crawled.agg(F.max("crawled_at").alias("max_crawled_at"))
    r = refined.agg(F.count("*").alias("refined_count"))
    orphans = lambda rows, name: rows.join(articles, "news_id", "left_anti").agg(F.count("*").alias(name))
    out = a.crossJoin(c).crossJoin(r).crossJoin(orphans(refined, "orphan_refined")).crossJoin(orphans(crawled, "orphan_crawled"))
    return out.withColumn("stale", F.coalesce(F.col("max_pub_date") < F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)), F.lit(True)))


def path_domain(metrics: DataFrame) -> DataFrame:
    """(path, rows) of unknown paths."""
    return metrics.filter(F.col("path").isNull() | ~F.col("path").isin("A1", "A2", "B", "C", "TOTAL")).groupBy("path").count()


def snapshot_shape(a2: DataFrame, c: DataFrame) -> DataFrame:
    """I4: (bad_items, latest_size): A2 items that are no arrays, and the size of the latest C snapshot, null without any."""
    bad = a2.agg(F.count_if(F.json_array_length("items").isNull()).alias("bad_items"))
    last = c.agg(F.max_by(F.size("news_ids"), "snapshot_at").alias("latest_size"))
    return bad.crossJoin(last)


def bandit_validity(state: DataFrame) -> DataFrame:
    """(invalid): rows without numbers or path, or of an unknown scope."""
    bad = F.col("alpha").isNull() | F.col("beta").isNull() | F.col("path").isNull() | ~F.coalesce(F.col("scope").isin("global", "user"), F.lit(False))
    return state.agg(F.count_if(bad).alias("invalid"))


def embedding_coverage(embeddings: DataFrame) -> DataFrame:
    """(type, rows, versions) for each of the three types."""
    wanted = embeddings.sparkSession.createDataFrame([(t,) for t in ("news", "keyword", "stock")], "type string")
    held = embeddings.groupBy(F.lower("entity_type").alias("type")).agg(F.count("*").alias("rows"), F.count_distinct("model_version").alias("versions"))
    return wanted.join(held, "type", "left").select("type", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("versions", F.lit(0)).alias("versions"))


def health_summary(checks: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(check, severity, message): a row for each check (name, one-row report, failing condition, message)."""
    out = None
    for name, report, condition, message in checks:
        row = report.agg(F.count_if(F.expr(condition)).alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") > 0, "failure").otherwise("ok").alias("severity"), F.when(F.col("n") > 0, message).otherwise("").alias("message"))
        out = row if out is None else out.unionByName(row)
    return out


def parse_request_log(lines: DataFrame) -> DataFrame:
    """The requests of log lines; other lines and broken JSON are left out."""
    return _logged(lines, "recommend_request", REQUEST)


def parse_impression_log(lines: DataFrame) -> DataFrame:
    """The impressions of log lines; other lines and broken JSON are left out."""
    return _logged(lines, "recommend_impression", IMPRESSION)


def _logged(lines: DataFrame, name: str, kind: str) -> DataFrame:
    body = F.regexp_extract("value", name + r" (\{.*\})\s*$", 1)
    rows = lines.filter(F.col("value").contains(name + " {")).select(F.from_json(body, kind).alias("r")).filter(F.col("r.request_id").isNotNull())
    return rows.select("r.*").withColumn("ts", F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("long")))


def request_counters(requests: DataFrame, minutes: int = 5) -> DataFrame:
    """Counts by window, state, experiment and variant. Cache, fallbacks, empty results and items are those of successful requests."""
    good = ~F.coalesce("error", F.lit(False))
    counts = requests.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "user_state", "experiment_id", "variant").agg(
        F.count("*").alias("requests"), F.count_if("error").alias("errors"), F.count_if(good & (F.col("cache_status") == "hit")).alias("cache_hits"),
        F.count_if(good & F.col("fallback_used")).alias("fallbacks"), F.count_if(good & (F.col("returned") == 0)).alias("empty"), F.coalesce(F.sum(F.when(good, F.col("returned"))), F.lit(0)).alias("items"),
    )
    return counts.select(F.col("w.start").alias("window_start"), *counts.columns[1:])


LABELS = ("user_state", "experiment_id", "variant")


def event_counters(requests: DataFrame, minutes: int = 5) -> DataFrame:
    """(window_start, user_state, experiment_id, variant, counter, label, count): requests by status, cache events
    by status, fallbacks by reason, prefetches by status and path. Only successful requests count beside the first."""
    good = ~F.coalesce("error", F.lit(False))
    named = lambda c, other: clean_label(F.coalesce(F.col(c), F.lit(other)))
    one = lambda when, counter, label: F.when(when, F.struct(F.lit(counter).alias("counter"), label.alias("label")))
    kinds = F.array(
        one(F.lit(True), "requests", F.when(good, "success").otherwise("error")),
        one(good, "cache", named("cache_status", "unknown")),
        one(good & F.col("fallback_used"), "fallback", named("fallback_reason", "unknown")),
        one(good & (F.coalesce("prefetch_status", F.lit("")) != ""), "prefetch", F.concat_ws(":", named("prefetch_status", ""), named("prefetch_trigger_path", "none"))),
    )
    rows = requests.select(F.window("ts", f"{minutes} minutes").alias("w"), *LABELS, F.explode(F.array_compact(kinds)).alias("x"))
    return rows.groupBy("w", *LABELS, "x.counter", "x.label").agg(F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), *LABELS, "counter", "label", "count")


def cursor_errors(rows: DataFrame, minutes: int = 5) -> DataFrame:
    """(window_start, experiment_id, variant, reason, count) of cursor errors (ts, experiment_id, variant, message)."""
    grouped = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "experiment_id", "variant", cursor_reason(F.col("message")).alias("reason")).agg(F.count("*").alias("count"))
    return grouped.select(F.col("w.start").alias("window_start"), "experiment_id", "variant", "reason", "count")


def label_mix(rows: DataFrame, label: str, minutes: int = 5) -> DataFrame:
    """(window_start, label, count, rate): shares of a label (path, HTTP status) of per-second rates, the denominator at least 1.

    ``rows`` has ts and the label; a missing one is 'unknown'.
    """
    counts = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(W.partitionBy("w"))
    per = lambda c: c / (60.0 * minutes)
    return counts.select(F.col("w.start").alias("window_start"), "label", "count", (per(F.col("count")) / F.greatest(per(total), F.lit(1.0))).alias("rate"))


def latency_histogram(requests: DataFrame, buckets: list[int], minutes: int = 5) -> DataFrame:
    """(window_start, le, count): requests up to each limit, added up."""
    counts = [F.count_if(F.col("latency_ms") <= b).alias(f"b{b}") for b in buckets]
    wide = requests.groupBy(F.window("ts", f"{minutes} minutes")["start"].alias("window_start")).agg(*counts)
    return wide.select("window_start", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("count")) for b in buckets])).alias("x")).select("window_start", "x.le", "x.count")


def histogram_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The quantile by straight lines between limits."""
    w = W.partitionBy("window_start")
    rows = histogram.withColumns({"total": F.max("count").over(w), "below": F.coalesce(F.lag("count").over(w.orderBy("le")), F.lit(0)), "low": F.coalesce(F.lag("le").over(w.orderBy("le")), F.lit(0))})
    hit = rows.filter((F.col("count") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    return hit.select("window_start", (F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / (F.col("count") - F.col("below"))).alias("quantile"))


def rates(counters: DataFrame, minutes: int = 5) -> DataFrame:
    """(window_start, alert, rate): ratios of per-second rates, the denominator at least 1: errors of all requests,
    fallbacks and empty results of the successful ones."""
    sums = counters.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in ("requests", "errors", "fallbacks", "empty")]).withColumn("successes", F.col("requests") - F.col("errors"))
    per = lambda c: F.col(c) / (60.0 * minutes)
    pairs = [F.struct(F.lit(n).alias("alert"), (per(c) / F.greatest(per(of), F.lit(1.0))).alias("rate")) for n, c, of in (("errors", "errors", "requests"), ("fallback", "fallbacks", "successes"), ("empty", "empty", "successes"))]
    return sums.select("window_start", F.explode(F.array(*pairs)).alias("x")).select("window_start", "x.alert", "x.rate")


def sustained_alerts(series: DataFrame, threshold: float, minutes: int, step: int = 5) -> DataFrame:
    """(alert, start, end) of runs of adjoining windows above the threshold that last at least so long."""
    above = series.filter(F.col("rate") > threshold)
    at = F.unix_seconds(F.col("window_start").cast("timestamp"))
    island = at - F.row_number().over(W.partitionBy("alert").orderBy("window_start")) * step * 60
    runs = above.withColumn("island", island).groupBy("alert", "island").agg(F.min("window_start").alias("start"), F.max("window_start").alias("last"), F.count("*").alias("n"))
    return runs.filter(F.col("n") * step >= minutes).select("alert", "start", (F.col("last") + F.make_interval(mins=F.lit(step))).alias("end"))


def online_metrics(impressions: DataFrame, opens: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    """(path, ctr, ctr_at_5, ...): opened shares of shown items, of all and of the first places."""
    keys = ["request_id", "user_id", "news_id"]
    rows = impressions.join(opens.select(*keys).distinct().withColumn("opened", F.lit(1)), keys, "left").withColumn("opened", F.coalesce("opened", F.lit(0)))
    at = [F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("opened"))) / F.nullif(F.count_if(F.col("rank") <= k), F.lit(0)), F.lit(0.0)).alias(f"ctr_at_{k}") for k in ks]
    return rows.groupBy("path").agg(F.count("*").alias("impressions"), F.avg("opened").alias("ctr"), *at)


def session_metrics(impressions: DataFrame, opens: DataFrame, states: DataFrame) -> DataFrame:
    """(user_state, sessions, first_click_rate, clicks_per_session, ctr), cold against warm.

    A session is a request; the first click rate is the share of sessions with any opened
    item. ``states`` (user_id, user_state) may lack users, who are 'unknown'.
    """
    keys = ["request_id", "user_id", "news_id"]
    rows = impressions.select(*keys).join(opens.select(*keys).distinct().withColumn("opened", F.lit(1)), keys, "left")
    each = rows.groupBy("request_id", "user_id").agg(F.count("*").alias("shown"), F.count("opened").alias("clicks"))
    named = each.join(states.select("user_id", "user_state"), "user_id", "left").withColumn("user_state", F.coalesce("user_state", F.lit("unknown")))
    return named.groupBy("user_state").agg(
        F.count("*").alias("sessions"), F.avg((F.col("clicks") > 0).cast("double")).alias("first_click_rate"),
        F.avg("clicks").alias("clicks_per_session"), (F.sum("clicks") / F.sum("shown")).alias("ctr"),
    )


def request_metrics(requests: DataFrame, *keys: str) -> DataFrame:
    """Requests, cache hit, fallback and prefetch success rates and latency at the median and 95 % by the keys.

    The prefetch rate is that of triggered prefetches which became 'ready', null without any.
    """
    ready = F.count_if(F.col("prefetch_triggered") & (F.col("prefetch_status") == "ready")) / F.nullif(F.count_if("prefetch_triggered"), F.lit(0))
    return requests.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.avg((F.col("cache_status") == "hit").cast("double")).alias("cache_hit_rate"), F.avg(F.col("fallback_used").cast("double")).alias("fallback_rate"),
        ready.alias("prefetch_success_rate"), F.percentile("latency_ms", 0.5).alias("latency_p50"), F.percentile("latency_ms", 0.95).alias("latency_p95"),
    )


def allocation_share(impressions: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, items, share): what share of the shown items each path gave, the mix ratio or a bandit's allocation."""
    counts = impressions.groupBy(*keys, "path").agg(F.count("*").alias("items"))
    return counts.withColumn("share", F.col("items") / F.sum("items").over(W.partitionBy(*(F.col(k) for k in keys))))
