"""Batch loads, assembled timelines, request rows and serving logs on small cases."""

from pyspark.sql import functions as F

from millrace.operators import evaluate, lake, monitoring, retrieval


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_load_batch_in_order(spark):
    """A mapping finds a keyword of its own batch; a missing sentiment is neutral; absent parts leave tables alone."""
    tables = {
        "keywords": spark.createDataFrame([("a", 1)], "keyword string, keyword_id long"),
        "news": spark.createDataFrame([(1, "t", "s", "x"), (2, "t", None, None)], "news_id long, refined_text string, summary string, sentiment string"),
        "news_stock": spark.createDataFrame([(1, 5, "old", 0.5)], "news_id long, stock_id long, extractor_version string, weight double"),
        "news_keyword": spark.createDataFrame([(1, 9, "old", 0.5), (3, 9, "old", 0.5)], "news_id long, keyword_id long, extractor_version string, weight double"),
    }
    batch = {
        "keywords": spark.createDataFrame([("b", 2)], "keyword string, keyword_id long"),
        "analysis": spark.createDataFrame([(2, "new"), (7, "no such news")], "news_id long, summary string"),
        "mentions": spark.createDataFrame([(1, "b"), (1, "b"), (1, "unknown")], "news_id long, keyword string"),
    }
    out = lake.load_batch(tables, batch)
    assert rows(out["news_keyword"]) == [(1, 2, "local_v1.0", 1.0), (3, 9, "old", 0.5)]
    assert rows(out["news"].select("news_id", "summary", "sentiment")) == [(1, "s", "x"), (2, "new", "중립")]
    assert rows(out["news_stock"]) == [(1, 5, "old", 0.5)]


def test_timeline_and_request_rows(spark):
    prefix = spark.createDataFrame([(1, 0, 10), (1, 1, 11)], "user_id long, pos long, news_id long")
    paths = spark.createDataFrame([(1, 10, "popular"), (1, 10, "popular")], "user_id long, news_id long, path string")
    mixed = spark.createDataFrame([(1, 0, 11, "behavior"), (1, 1, 12, "behavior")], "user_id long, pos long, news_id long, path string")
    assert rows(retrieval.assemble_timeline(prefix, paths, mixed)) == [(1, 0, 10, "popular"), (1, 1, 11, "unknown"), (1, 2, 12, "behavior")]
    sessions = spark.createDataFrame([(1, "hit"), (2, "miss")], "user_id long, cache_status string")
    got = retrieval.request_rows(sessions, mixed.select("user_id", "news_id", "path"), prefix)
    assert rows(got) == [(1, "hit", 0, 1, 0, 0), (2, "miss", 0, 0, 0, 0)]


def test_log_lines(spark):
    lines = spark.createDataFrame([('x recommend_impression {"request_id": "r", "rank": 3, "timestamp": 1.5}',), ("x recommend_impression {broken}",), ('x recommend_request {"request_id": "q"}',), (None,)], "value string")
    assert rows(monitoring.parse_impression_log(lines).select("request_id", "rank", F.unix_micros("ts"))) == [("r", 3, 1500000)]
    requests = monitoring.parse_request_log(lines).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("fallback_used", F.lit(True))
    assert rows(monitoring.event_counters(requests).select("counter", "label", "count")) == [("cache", "unknown", 1), ("fallback", "unknown", 1), ("requests", "success", 1)]


def test_golden_without_news(spark):
    """A case without news counts as 0; no cases at all give a missing score."""
    cases = spark.createDataFrame([("c", 1, 2)], "category string, src long, dst long")
    vectors = spark.createDataFrame([(2, [1.0, 0.0])], "id long, vector array<double>")
    edges = spark.createDataFrame([], "src long, dst long")
    groups, final = evaluate.golden_eval(cases, edges, vectors, vectors, 10)
    assert rows(groups) == [("all", 1, 0.0, 0.0), ("c", 1, 0.0, 0.0)] and rows(final) == [(0.0, 0)]
    assert rows(evaluate.golden_eval(cases.limit(0), edges, vectors, vectors, 10)[1]) == [(0.0, 1)]
