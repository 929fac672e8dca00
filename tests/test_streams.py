"""Streams over a finished file source equal the batch operators."""

from datetime import timedelta
from functools import reduce

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources import adapters
from millrace.streaming import streams

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('events')}/table"
    rows = adapters.interactions(spark, SMALL).withColumn("event_ts_server", F.col("event_ts_server").cast("timestamp")).withColumn("event_ts_client", F.col("event_ts_client").cast("timestamp"))
    rows.repartitionByRange(4, "event_ts_server").sortWithinPartitions("event_ts_server").write.parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_hourly_counts(spark, events, tmp_path):
    got = streams.finished(streams.hourly_counts(stream(spark, events), late="60 days"), "k3", str(tmp_path), "update")
    last = got.groupBy("window_start", "event_type").agg(F.max("events"))
    want = spark.read.parquet(events).groupBy(F.window("event_ts_server", "1 hour")["start"], "event_type").count()
    assert rows(last) == rows(want)


def test_dwell_join(spark, events, tmp_path):
    # Files come in the order in which they were closed, so the watermark must bear the whole period.
    got = streams.finished(streams.dwell_join(stream(spark, events), "1 hour", "60 days"), "k4", str(tmp_path))
    want = streams.dwell_join(spark.read.parquet(events), "1 hour")
    assert rows(got) == rows(want) and got.count() > 0


def test_url_dedup(spark, events, tmp_path):
    urls = stream(spark, events).select("event_ts_server", F.col("content_session_id").alias("url"))
    got = streams.finished(streams.dedup_urls(urls, "event_ts_server", "60 days"), "k1", str(tmp_path))
    assert got.count() == spark.read.parquet(events).select("content_session_id").distinct().count()


def test_content_dedup(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("news_id"), "text", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    streams.dedup_content(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/reg", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("content_hash").distinct().count() == docs.select(F.md5(F.translate("text", " \n\r\t", ""))).distinct().count()


def test_recent_actions(spark, events, tmp_path):
    source = stream(spark, events).select("user_id", "news_id", F.col("event_ts_server").alias("action_ts"))
    streams.updates(streams.recent_actions(source, 3, late="60 days"), f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    every = spark.read.parquet(f"{tmp_path}/t")
    newest = every.groupBy("user_id").agg(F.max("batch").alias("batch"))
    got = every.join(newest, ["user_id", "batch"]).select("user_id", "news_id", "action_ts")
    order = W.partitionBy("user_id").orderBy(F.desc("action_ts"), F.desc("news_id"))
    want = spark.read.parquet(events).select("user_id", "news_id", F.col("event_ts_server").alias("action_ts")).distinct().withColumn("rn", F.row_number().over(order)).filter("rn <= 3").drop("rn")
    assert rows(got) == rows(want) and every.select("batch").distinct().count() > 1


def test_recent_actions_forgets(spark, tmp_path):
    """A user's actions go once the watermark is past their time to live: the later action starts a new list."""
    for n, day in enumerate(("2024-01-01", "2024-03-01", "2024-03-02")):
        user = 2 if n == 1 else 1
        spark.createDataFrame([(user, n, day)], "user_id long, news_id long, day string").select("user_id", "news_id", F.col("day").cast("timestamp").alias("action_ts")).write.mode("append").parquet(f"{tmp_path}/in")
        streams.updates(streams.recent_actions(stream(spark, f"{tmp_path}/in"), ttl="10 days", late="0 seconds"), f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    every = spark.read.parquet(f"{tmp_path}/t")
    last = every.filter("user_id = 1").orderBy(F.desc("as_of")).first()["as_of"]
    assert [r["news_id"] for r in every.filter((F.col("user_id") == 1) & (F.col("as_of") == last)).collect()] == [2]


def test_sessions(spark, events, tmp_path):
    """Sessions that the watermark has closed are those of the batch form, which ends within the period."""
    got = streams.written(streams.session_activity(stream(spark, events), late="60 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    whole = streams.written(streams.session_activity(spark.readStream.schema(spark.read.parquet(events).schema).parquet(events)), f"{tmp_path}/out2", f"{tmp_path}/cp2")
    want = streams.session_activity(spark.read.parquet(events))
    assert got.count() == 0  # nothing is closed while all of the period may still come
    end = spark.read.parquet(events).agg(F.max("event_ts_server") - F.expr("INTERVAL 90 MINUTES")).first()[0]
    assert rows(whole) == rows(want.filter(F.col("last") <= F.lit(end))) and whole.count() > 0


def test_rolling_posterior(spark, tmp_path):
    hours = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id"))).alias("bucket_end"), F.when(F.col("id") % 3 == 0, "A1").otherwise("B").alias("path"), (F.col("id") % 5).alias("dwell_5s_count"), (F.col("id") % 7 + 5).alias("impression_count"))
    hours.repartition(3).write.parquet(f"{tmp_path}/in")
    got = streams.finished(streams.rolling_posterior(stream(spark, f"{tmp_path}/in"), late="60 days"), "k7", f"{tmp_path}/cp", "update")
    got = got.groupBy("window_end", "path").agg(F.max("reward_count"), F.max("impression_count"))
    facts = [tuple(r) for r in hours.collect()]
    first = facts[0][0]
    want = {}
    for at, path, reward, shown in facts:
        for ahead in range(1, 73):
            key = (at + timedelta(hours=ahead), path)
            have = want.get(key, (0, 0))
            want[key] = (have[0] + reward, have[1] + shown)
    assert rows(got) == sorted((end, path, r, n) for (end, path), (r, n) in want.items()) and first < min(k[0] for k in want)


def test_log_alerts(spark, tmp_path):
    """Errors in three adjoining windows alert, in a single one they don't; open windows are left out."""
    minute = lambda n: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.lit(n))
    parts = [spark.range(1).select(minute(n).alias("ts"), F.lit(n in (5, 10, 15, 40, 100)).alias("error")) for n in (0, 5, 10, 15, 20, 40, 100)]
    log = reduce(lambda x, y: x.unionByName(y), parts)
    fields = {"user_state": F.lit("warm"), "experiment_id": F.lit("e"), "variant": F.lit("v"), "cache_status": F.lit("hit"), "fallback_used": F.lit(False), "returned": F.lit(1)}
    log.withColumns(fields).coalesce(1).write.parquet(f"{tmp_path}/in")
    streams.log_alerts(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", 0.0, 10).awaitTermination()
    alerts = spark.read.parquet(f"{tmp_path}/out/alerts")
    last = alerts.agg(F.max("version")).first()[0]
    got = alerts.filter(F.col("version") == last).select("alert", F.date_format("start", "HH:mm"), F.date_format("end", "HH:mm"))
    assert rows(got) == [("errors", "00:05", "00:20")]
    assert spark.read.parquet(f"{tmp_path}/out/windows").filter("alert = 'errors'").count() == 6  # that of minute 100 is open
