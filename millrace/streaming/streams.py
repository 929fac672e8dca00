"""Structured Streaming forms (2.K). On finished input each gives what its batch operator gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import funnel, monitoring, parts


def dedup_urls(items: DataFrame, time: str = "created_at", memory: str = "3 days") -> DataFrame:
    """K1: the first item of each url; urls are remembered as long as the watermark says."""
    return items.withWatermark(time, memory).dropDuplicatesWithinWatermark(["url"])


def dedup_content(rows: DataFrame, registry_path: str, out_path: str, checkpoint: str):
    """K2: keeps rows of new content hashes; the registry lies in parts by hash, each batch adds to it under its own number.

    Only parts that the registry's Bloom filters name for the batch are read. A batch that is run again reads the
    registry without its own rows and overwrites them.
    """

    def each(batch: DataFrame, number: int) -> None:
        first = funnel.dedup_in_batch(batch).filter("is_first").drop("is_first").persist()
        known = parts.registered(batch.sparkSession, registry_path, first, before=number)
        new = first.join(known, "content_hash", "left_anti").persist()
        new.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        parts.register(new, registry_path, number)
        new.unpersist()
        first.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, time: str = "event_ts_server", late: str = "1 hour") -> DataFrame:
    """K3: (window_start, event_type, events) by tumbling hour."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "events")


def dwell_join(interactions: DataFrame, grace: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """K4: opens with leaves of their session up to ``grace`` after; rows later than the watermark are dropped."""
    at = F.coalesce("event_ts_client", "event_ts_server")
    rows = interactions.withColumn("at", at)
    opens = rows.filter("event_type = 'content_open'").withWatermark("event_ts_server", late).select("user_id", "news_id", F.col("content_session_id").alias("session"), F.col("at").alias("open_ts"), F.col("event_ts_server").alias("open_server"))
    leaves = rows.filter("event_type = 'content_leave'").withWatermark("event_ts_server", late).select("content_session_id", F.col("at").alias("leave_ts"), F.col("event_ts_server").alias("leave_server"))
    near = F.expr(f"session = content_session_id AND leave_server >= open_server AND leave_server <= open_server + interval {grace}")
    return opens.join(leaves, near).filter("leave_ts >= open_ts").select("user_id", "news_id", "session", "open_ts", "leave_ts")


def session_activity(interactions: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """K5: (user_id, content_session_id, first, last, seconds) of sessions that a gap closes; those of 5 s qualify."""
    rows = interactions.withWatermark("event_ts_server", late)
    grouped = rows.groupBy(F.session_window("event_ts_server", gap).alias("s"), "user_id", "content_session_id").agg(F.min("event_ts_server").alias("first"), F.max("event_ts_server").alias("last"))
    seconds = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6
    return grouped.select("user_id", "content_session_id", "first", "last", seconds.alias("seconds")).filter("seconds >= 5")


def recent_actions(actions: DataFrame, per_user: int = 20, ttl: str = "90 days", late: str = "1 hour") -> DataFrame:
    """K6: (user_id, news_id, action_ts, as_of) in update mode: a user's latest actions whenever a batch changes them.

    The state holds at most ``per_user`` actions of a user and goes once the watermark is
    ``ttl`` past the last of them. A user's rows come in chunks, so a batch of any size needs
    no more memory than one chunk. Rows with one ``as_of`` (micros of the newest action) are
    one list; repeated actions count once, and those without a user, news or time are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    keep_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def update(key, chunks, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = set(zip(*state.get)) if state.exists else set()
        before = set(held)
        for chunk in chunks:
            held |= set(zip(chunk["at"].tolist(), chunk["news_id"].tolist()))
            held = set(sorted(held, reverse=True)[:per_user])
        ranked = sorted(held, reverse=True)
        times, news = [at for at, _ in ranked], [n for _, n in ranked]
        state.update((times, news))
        state.setTimeoutTimestamp(max(times[0] // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        if held != before:
            yield pd.DataFrame({"user_id": key[0], "news_id": news, "at": times, "as_of": times[0]})

    rows = actions.withWatermark("action_ts", late).filter("user_id IS NOT NULL AND news_id IS NOT NULL AND action_ts IS NOT NULL")
    rows = rows.select("user_id", "news_id", "action_ts", F.unix_micros("action_ts").alias("at"))
    found = rows.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, news_id long, at long, as_of long", "times array<long>, news array<long>", "update", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("user_id", "news_id", F.timestamp_micros("at").alias("action_ts"), "as_of")


def rolling_posterior(metrics: DataFrame, hours: int = 72, step: int = 1, late: str = "1 hour") -> DataFrame:
    """K7: (window_end, path, reward_count, impression_count) over a sliding window."""
    window = F.window("bucket_end", f"{hours} hours", f"{step} hours")
    rows = metrics.withWatermark("bucket_end", late).groupBy(window.alias("w"), "path")
    return rows.agg(F.sum("dwell_5s_count").alias("reward_count"), F.sum("impression_count").alias("impression_count")).select(F.col("w.end").alias("window_end"), "path", "reward_count", "impression_count")


def log_counters(requests: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """K8: the counters of request logs by window."""
    return monitoring.request_counters(requests.withWatermark("ts", late), minutes)


def log_alerts(requests: DataFrame, path: str, checkpoint: str, threshold: float, lasting: int, minutes: int = 5, late: str = "10 minutes"):
    """K8: alerts over closed windows of the request log, as the table ``path``/alerts, one version for each batch.

    Every batch adds its closed windows under its own number and derives the alerts from all
    of them; there is one small row for each window and kind, however many requests it holds.
    A batch that is run again overwrites its own parts only.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        monitoring.rates(batch, minutes).write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
        series = spark.read.parquet(f"{path}/windows").filter(F.col("batch") <= number).drop("batch")
        monitoring.sustained_alerts(series, threshold, lasting, minutes).write.mode("overwrite").parquet(f"{path}/alerts/version={number}")

    counters = log_counters(requests, minutes, late)
    return counters.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream appends once its present input is read through, written as a Parquet table and read back."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def updates(stream: DataFrame, path: str, checkpoint: str):
    """Starts a stream in update mode whose batches are kept as ``path``/batch=n, for readers that take the newest rows."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives once its present input is read through, as a table in memory (for tests and small results)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


Stream = Callable[[DataFrame], DataFrame]
