"""Views of the given tables in the shape of the platform's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The period that the given events cover, and the moment of the snapshots made from it.
START, END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
PATHS = ("A1", "A2", "B", "C")

#: CTEs that begin every SQL text; later ones build on them.
SQL = """WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    user_id || '-' || strftime(ts, '%Y%m%d') AS rid FROM events),
interactions AS (
  SELECT user_id, CASE event_type WHEN 'view' THEN 'content_open' WHEN 'purchase' THEN 'content_leave' ELSE 'content_heartbeat' END AS event_type,
    k AS news_id, rid AS content_session_id, rid AS request_id,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS event_ts_client, ts AS event_ts_server
  FROM ev WHERE event_type IN ('view', 'purchase', 'click')),
served AS (
  SELECT min(event_id) OVER (PARTITION BY rid, user_id) AS id, rid AS request_id, user_id, min(ts) OVER (PARTITION BY rid, user_id) AS created_at,
    k AS news_id, ['A1', 'A2', 'B', 'C'][1 + event_id % 4] AS path,
    row_number() OVER (PARTITION BY rid, user_id ORDER BY ts, event_id) AS position FROM ev),
articles AS (SELECT o_orderkey AS news_id, o_orderdate AS pub_date, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders),
news_keyword AS (SELECT DISTINCT l_orderkey AS news_id, p_brand AS keyword FROM lineitem JOIN part ON l_partkey = p_partkey),
news_stock AS (SELECT DISTINCT l_orderkey AS news_id, l_suppkey AS stock_id FROM lineitem)"""


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("long"),
            "rid": F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")),
        }
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, news_id, content_session_id, request_id, event_ts_client, event_ts_server)."""
    kind = F.when(F.col("event_type") == "view", "content_open").when(F.col("event_type") == "purchase", "content_leave").otherwise("content_heartbeat")
    return _events(spark, sf_dir).filter(F.col("event_type").isin("view", "purchase", "click")).select(
        "user_id", kind.alias("event_type"), F.col("k").alias("news_id"), F.col("rid").alias("content_session_id"), F.col("rid").alias("request_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("event_ts_client"), F.col("ts").alias("event_ts_server"),
    )


def serves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, request_id, user_id, created_at, served_items): one row per request, its items a JSON array."""
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % 4 + 1).cast("int"))
    order = W.partitionBy("rid", "user_id").orderBy("ts", "event_id")
    items = _events(spark, sf_dir).withColumn("position", F.row_number().over(order))
    item = F.struct("position", F.col("k").cast("string").alias("news_id"), path.alias("path"))
    return items.groupBy(F.col("rid").alias("request_id"), "user_id").agg(
        F.min("event_id").alias("id"), F.min("ts").alias("created_at"), F.to_json(F.sort_array(F.collect_list(item))).alias("served_items")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("news_id"), F.col("o_orderdate").alias("pub_date"), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


def news_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey"), read(spark, sf_dir, "part", "p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("news_id"), F.col("p_brand").alias("keyword")).distinct()


def news_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").select(F.col("l_orderkey").alias("news_id"), F.col("l_suppkey").alias("stock_id")).distinct()
