"""Queries for 2.K: each reads its whole table as a stream, to the end of what is there.

Windows are given once the watermark has passed them, so the SQL leaves out those that end
within the allowed lateness before the newest row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lake
from millrace.operators import monitoring as m
from millrace.plans import behaviour as bq
from millrace.plans import evaluate as hq
from millrace.plans.behaviour import SQL_D
from millrace.plans.evaluate import SQL_J, ntz
from millrace.plans.keep import folder
from millrace.plans.text import SQL_T
from millrace.sources import adapters as a
from millrace.streaming import streams as k

LATE = 60  # minutes


def source(s, path):
    """A table, one file or a folder, as a stream; local times become moments, as watermarks ask for them."""
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may name a file too
    rows = s.readStream.schema(s.read.parquet(path).schema).parquet(either)
    return rows.select(*[F.col(c).cast("timestamp") if t in ("timestamp_ntz", "timestamp") else F.col(c) for c, t in rows.dtypes])


def events(s, p):
    """Events as interactions, row by row (the adapters' view without its joins)."""
    kind = F.when(F.col("event_type") == "view", "content_open").when(F.col("event_type") == "purchase", "content_leave").otherwise("content_heartbeat")
    session = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    return source(s, f"{p}/events.parquet").filter(F.col("event_type").isin("view", "purchase", "click")).select(
        "user_id", kind.alias("event_type"), F.get_json_object("props", "$.k").cast("long").alias("news_id"), session.alias("content_session_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("event_ts_client"), F.col("ts").alias("event_ts_server"),
    )


def appended(s, stream, name):
    return k.written(stream, folder(s, name), folder(s, f"{name}-progress"))


def _urls(s, p):
    rows = events(s, p).select("event_ts_server", F.col("content_session_id").alias("url"))
    return appended(s, k.dedup_urls(rows, "event_ts_server"), "k01").select("url")


def _content(s, p):
    rows = source(s, f"{p}/documents.parquet").select(F.col("doc_id").alias("news_id"), "text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id") * 7)).alias("created_at"))
    out = folder(s, "k02")
    k.dedup_content(rows, folder(s, "k02-registry"), out, folder(s, "k02-progress")).awaitTermination()
    return s.read.parquet(out).select("news_id", "content_hash")


def _recent(s, p):
    rows = events(s, p).select("user_id", "news_id", F.col("event_ts_server").alias("action_ts"))
    out = folder(s, "k06")
    k.updates(k.recent_actions(rows), out, folder(s, "k06-progress")).awaitTermination()
    every = s.read.parquet(out)
    newest = every.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return ntz(every.join(newest, ["user_id", "batch"]).select("user_id", "news_id", "action_ts"), "action_ts")


def _posterior(s, p):
    """Hourly rows by path: shown items by the hour of their request, opened ones as rewards."""
    serves = a.serves(s, p)
    shown = bq.d.explode_served_items(serves, bq.START, bq.END).join(serves.select("id", "created_at"), "id")
    hour = F.date_trunc("hour", F.col("created_at")) + F.expr("INTERVAL 1 HOUR")
    hourly = shown.groupBy(hour.alias("bucket_end"), "path").agg(F.count("*").alias("impression_count"), F.count_if(F.col("position") == 1).alias("dwell_5s_count"))
    held = folder(s, "k07-hourly")
    hourly.write.parquet(held)
    return ntz(appended(s, k.rolling_posterior(source(s, held)), "k07"), "window_end")


def _lines(s, p):
    held = folder(s, "k08-log")
    hq.log_lines(s, p).write.text(held)
    return m.parse_request_log(s.readStream.text(held))


def _alerts(s, p):
    out = folder(s, "k08")
    query = k.log_alerts(_lines(s, p), out, folder(s, "k08-progress"), 0.0, 10)
    query.awaitTermination()
    every = s.read.parquet(f"{out}/alerts")
    newest = every.agg(F.max("version").alias("version"))
    return ntz(every.join(F.broadcast(newest), "version").select("alert", "start", "end"), "start", "end")


def _windows(s, p):
    """Interactions written by processing window (a day); what each window holds, read back."""
    out = folder(s, "a08")
    rows = a.interactions(s, p).withColumns({"window_start": F.date_format("event_ts_server", "yyyyMMdd0000"), "window_end": F.date_format("event_ts_server", "yyyyMMdd2359")})
    lake.write_windows(rows, out)
    return s.read.parquet(out).groupBy(F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end")).agg(F.count("*").alias("rows"), F.sum("news_id").alias("ids"))


CLOSED = "{end} <= (SELECT max({ts}) - INTERVAL {late} MINUTE FROM {rows})"
QUERIES = {
    "a08_write_windows": _windows,
    "k01_stream_urls": _urls,
    "k02_stream_content": _content,
    "k03_stream_hourly_counts": lambda s, p: ntz(appended(s, k.hourly_counts(events(s, p)), "k03"), "window_start"),
    "k04_stream_dwells": lambda s, p: ntz(appended(s, k.dwell_join(events(s, p)), "k04"), "open_ts", "leave_ts"),
    "k05_stream_sessions": lambda s, p: ntz(appended(s, k.session_activity(events(s, p)), "k05"), "first", "last"),
    "k06_stream_recent_actions": _recent,
    "k07_stream_posterior": _posterior,
    "k08_stream_counters": lambda s, p: ntz(appended(s, k.log_counters(_lines(s, p)), "k08c"), "window_start"),
    "k08_stream_alerts": _alerts,
}
ORACLES = {
    "a08_write_windows": SQL_D + " SELECT strftime(event_ts_server, '%Y%m%d0000') AS window_start, strftime(event_ts_server, '%Y%m%d2359') AS window_end, count(*) AS rows, sum(news_id)::BIGINT AS ids FROM interactions GROUP BY ALL",
    "k01_stream_urls": SQL_D + " SELECT DISTINCT content_session_id AS url FROM interactions",
    "k02_stream_content": SQL_T + " SELECT news_id, content_hash FROM hashed QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY created_at, news_id) = 1",
    "k03_stream_hourly_counts": SQL_D + " SELECT date_trunc('hour', event_ts_server) AS window_start, event_type, count(*) AS events FROM interactions WHERE "
    + CLOSED.format(end="date_trunc('hour', event_ts_server) + INTERVAL 1 HOUR", ts="event_ts_server", late=LATE, rows="interactions") + " GROUP BY ALL",
    "k04_stream_dwells": SQL_D + """, acts AS (SELECT *, coalesce(event_ts_client, event_ts_server) AS at FROM interactions)
    SELECT o.user_id, o.news_id, o.content_session_id AS session, o.at AS open_ts, l.at AS leave_ts FROM acts o JOIN acts l USING (content_session_id)
    WHERE o.event_type = 'content_open' AND l.event_type = 'content_leave' AND l.event_ts_server BETWEEN o.event_ts_server AND o.event_ts_server + INTERVAL 1 HOUR AND l.at >= o.at""",
    "k05_stream_sessions": SQL_D + """, steps AS (SELECT *, coalesce(event_ts_server - lag(event_ts_server) OVER w >= INTERVAL 30 MINUTE, true)::INT AS fresh FROM interactions WINDOW w AS (PARTITION BY user_id, content_session_id ORDER BY event_ts_server)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, content_session_id ORDER BY event_ts_server ROWS UNBOUNDED PRECEDING) AS run FROM steps),
    whole AS (SELECT user_id, content_session_id, min(event_ts_server) AS first, max(event_ts_server) AS last FROM runs GROUP BY user_id, content_session_id, run)
    SELECT user_id, content_session_id, first, last, (epoch_us(last) - epoch_us(first)) / 1e6 AS seconds FROM whole WHERE epoch_us(last) - epoch_us(first) >= 5000000 AND """
    + CLOSED.format(end="last + INTERVAL 30 MINUTE", ts="event_ts_server", late=LATE, rows="interactions"),
    "k06_stream_recent_actions": SQL_D + """ SELECT user_id, news_id, action_ts FROM (SELECT DISTINCT user_id, news_id, event_ts_server AS action_ts FROM interactions WHERE news_id IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY action_ts DESC, news_id DESC) <= 20""",
    "k07_stream_posterior": SQL_D + """, hourly AS (SELECT date_trunc('hour', created_at) + INTERVAL 1 HOUR AS bucket_end, path, count(*) AS shown, count(*) FILTER (position = 1) AS reward FROM items GROUP BY ALL),
    slid AS (SELECT bucket_end + to_hours(i) AS window_end, path, sum(reward)::BIGINT AS reward_count, sum(shown)::BIGINT AS impression_count FROM hourly, range(1, 73) t(i) GROUP BY ALL)
    SELECT * FROM slid WHERE """ + CLOSED.format(end="window_end", ts="bucket_end", late=LATE, rows="hourly"),
    "k08_stream_counters": SQL_J + """ SELECT window_start, user_state, 'exp' AS experiment_id, variant, count(*) AS requests, count(*) FILTER (error) AS errors, count(*) FILTER (NOT error AND cache_status = 'hit') AS cache_hits,
    count(*) FILTER (NOT error AND fallback_used) AS fallbacks, count(*) FILTER (NOT error AND returned = 0) AS empty, coalesce(sum(returned) FILTER (NOT error), 0)::BIGINT AS items FROM wins WHERE """
    + CLOSED.format(end="window_start + INTERVAL 5 MINUTE", ts="ts", late=10, rows="wins") + " GROUP BY ALL",
    "k08_stream_alerts": SQL_J + ", shut AS (SELECT * FROM wins WHERE " + CLOSED.format(end="window_start + INTERVAL 5 MINUTE", ts="ts", late=10, rows="wins") + """),
    r AS (SELECT DISTINCT window_start, alert FROM (SELECT window_start, 'errors' AS alert FROM shut WHERE error UNION ALL SELECT window_start, 'fallback' FROM shut WHERE NOT error AND fallback_used UNION ALL SELECT window_start, 'empty' FROM shut WHERE NOT error AND returned = 0)),
    g AS (SELECT *, epoch(window_start) - 300 * row_number() OVER (PARTITION BY alert ORDER BY window_start) AS i FROM r)
    SELECT alert, min(window_start) AS start, max(window_start) + INTERVAL 5 MINUTE AS "end" FROM g GROUP BY alert, i HAVING count(*) * 5 >= 10""",
}
