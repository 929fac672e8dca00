"""E5: the windows of the popular fallback, and its query over whole tables."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from millrace.operators import retrieval
from millrace.plans import registry


def test_query_ranks_all_news_by_all_metrics(spark, tmp_path):
    """News of any age are ranked by the clicks of the whole month, and as the SQL ranks them."""
    dates = {1: "1993-01-01", 2: "1998-06-30", 3: "1998-07-02", 4: "1980-01-01"}  # 3 is not out yet
    shown = [(1, "view"), (1, "view"), (1, "view"), (1, "click"), (4, "view"), (4, "click"), (2, "click"), (3, "view")]
    orders = spark.createDataFrame(list(dates.items()), "o_orderkey long, o_orderdate string")
    orders = orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).withColumns({c: F.lit(1) for c in ("o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")})
    events = spark.createDataFrame([(i, i, kind, 1.0, f'{{"k": {news}}}') for i, (news, kind) in enumerate(shown)], "event_id long, user_id long, event_type string, value double, props string")
    events = events.withColumn("ts", F.lit("2024-01-03 10:00:00").cast("timestamp_ntz"))
    for name, table in (("orders", orders), ("events", events)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    got = [tuple(r) for r in registry.QUERIES["e05_popular_fallback"](spark, str(tmp_path)).collect()]
    assert got == [(1, 0.75, datetime(1993, 1, 1)), (4, 0.5, datetime(1980, 1, 1)), (2, 0.0, datetime(1998, 6, 30))]
    db = duckdb.connect()
    for name in ("orders", "events"):
        db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert db.execute(registry.ORACLES["e05_popular_fallback"]).fetchall() == got


def test_windows(spark):
    """Three days of news and seven of metrics unless lifted, each by itself."""
    articles = spark.createDataFrame([(1, "2024-01-31"), (2, "2024-01-29"), (3, "2024-01-28"), (4, "2024-02-02")], "news_id long, pub_date string").withColumn("pub_date", F.col("pub_date").cast("timestamp_ntz"))
    metrics = spark.createDataFrame([(2, "A1", 1, 4, "2024-01-25"), (2, "TOTAL", 9, 9, "2024-01-30"), (1, "B", 3, 4, "2024-01-24"), (3, "C", 1, 2, "2024-01-01")], "news_id long, path string, click_count long, impression_count long, bucket_start string")
    metrics = metrics.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))
    ranked = lambda **given: [(r.news_id, r.ctr) for r in retrieval.popular_fallback(articles, metrics, "2024-02-01 00:00:00", 10, **given).collect()]
    assert ranked() == [(2, 0.25), (1, 0.0)]
    assert ranked(hours=None) == [(2, 0.25), (1, 0.0), (3, 0.0)]
    assert ranked(days=None) == [(1, 0.75), (2, 0.25)]
    assert ranked(hours=None, days=None) == [(1, 0.75), (3, 0.5), (2, 0.25)]
