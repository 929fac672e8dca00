"""Sources, sinks and table maintenance (2.A). Every operator returns the new state of the table it changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "passed", "skipped", "filtered_out", "failed_retryable", "failed_permanent")


def _utc(kst: str) -> Column:
    """A moment of Korean time in UTC, so that the filter compares the stored column itself."""
    return (F.lit(kst).cast("timestamp_ntz") - F.expr("interval 9 hours")).cast("timestamp_ntz")


def scan_window(crawled: DataFrame, articles: DataFrame, start: str, end: str) -> DataFrame:
    """A1: crawled rows made in [start, end) of Korean time, with their articles."""
    rows = crawled.filter((F.col("created_at") >= _utc(start)) & (F.col("created_at") < _utc(end)))
    return rows.join(articles, "news_id")


def scan_day(crawled: DataFrame, articles: DataFrame, day: str) -> DataFrame:
    """A2: the rows of one Korean day up to and with 23:59:59; later parts of that second are left out."""
    rows = crawled.filter((F.col("created_at") >= _utc(f"{day} 00:00:00")) & (F.col("created_at") <= _utc(f"{day} 23:59:59")))
    return rows.join(articles, "news_id")


def parse_search_items(items: DataFrame) -> DataFrame:
    """A3: items of a search answer as articles: tags out of titles, dates of mail headers, the first url that isn't blank."""
    url = F.coalesce(F.nullif(F.trim("originallink"), F.lit("")), F.nullif(F.trim("link"), F.lit("")), F.lit(""))
    dated = F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", "")
    return items.select(F.regexp_replace("title", "<.*?>", "").alias("title"), F.try_to_timestamp(dated, F.lit("d MMM yyyy HH:mm:ss Z")).cast("timestamp_ntz").alias("pub_date"), url.alias("url"), "search_keyword")


def ingest_new_urls(items: DataFrame, seen: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """A4: items whose url is new: not among those seen in the last days, and the first of its url by news_id."""
    recent = seen.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))).select("url")
    first = F.row_number().over(W.partitionBy("url").orderBy("news_id"))
    return items.join(recent, "url", "left_anti").withColumn("rn", first).filter("rn = 1").drop("rn")


def read_stock_master(spark: SparkSession, path: str, encoding: str = "cp949") -> DataFrame:
    """A5: the stock list; rows without ISIN are dropped, the code is part of it and stays text.

    Spark's own reader knows only Unicode and Latin files, so the bytes are decoded in tasks, file by file.
    """

    def lines(batches):
        for batch in batches:
            for content in batch["content"]:
                said = [line for line in content.decode(encoding).splitlines() if line.strip()]
                yield pd.DataFrame({"nth": range(len(said)), "line": said})

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "nth long, line string")
    names = [c.strip().strip('"') for c in text.filter("nth = 0").first().line.lstrip("\ufeff").split(",")]
    row = F.from_csv("line", ", ".join(f"`{c}` string" for c in names), {"mode": "PERMISSIVE"})
    rows = text.filter("nth > 0").select(row.alias("r")).select("r.*").filter(F.coalesce(F.col("isin"), F.lit("")) != "")
    return rows.withColumn("stock_id", F.substring("isin", 4, 6))


def explode_aliases(stocks: DataFrame) -> DataFrame:
    """(stock_id, alias_name), each once."""
    return stocks.select("stock_id", F.explode(F.split("aliases", ",")).alias("a")).select("stock_id", F.trim("a").alias("alias_name")).filter("alias_name <> ''").distinct()


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """A10: the last row of each key by the order."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("rn", last).filter("rn = 1").drop("rn")


def merge_partition(existing: DataFrame, new: DataFrame, key: str = "news_id") -> DataFrame:
    """Both together; of rows with one key the new one stays."""
    both = existing.withColumn("tag", F.lit(0)).unionByName(new.withColumn("tag", F.lit(1)))
    return keep_last(both, [key], "tag").drop("tag")


def write_daily(rows: DataFrame, path: str, date: str = "pub_date") -> None:
    """Writes rows under year=/month=/day=; only the partitions that occur are replaced."""
    at = F.col(date)
    parts = rows.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")})
    parts.repartition("year", "month", "day").write.partitionBy("year", "month", "day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_window(rows: DataFrame, path: str, start: str, end: str) -> None:
    """Writes the rows of one processing window under window_start=/window_end=."""
    marked = rows.withColumns({"window_start": F.lit(start), "window_end": F.lit(end)})
    marked.write.partitionBy("window_start", "window_end").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_windows(rows: DataFrame, path: str) -> None:
    """The same for rows of many windows at once, which carry window_start and window_end; salted, so that a large window is several files."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if not c.startswith("window_")]), F.lit(8))
    spread = rows.repartition("window_start", "window_end", salt)
    spread.write.partitionBy("window_start", "window_end").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def scan_windows_of_day(windows: DataFrame, day: str) -> DataFrame:
    """Rows of the windows that begin on a day (yyyyMMdd); the filter prunes partitions."""
    return windows.filter(F.col("window_start").cast("string").startswith(day))


def latest_snapshot(snapshots: DataFrame, mode: str = "on_or_before", date: str | None = None) -> DataFrame:
    """The newest ``date`` on or before, or before a day, or of all ('unbounded'); null where there is none."""
    held = {"on_or_before": F.col("date") <= date, "strictly_before": F.col("date") < date, "unbounded": F.lit(True)}[mode] if date else F.lit(True)
    return snapshots.filter(held).agg(F.max("date").alias("date"))


def list_date_partitions(paths: DataFrame) -> DataFrame:
    """Dates named in paths."""
    pattern = r"year=(\d{4})/month=(\d{2})/day=(\d{2})"
    parts = [F.regexp_extract("path", pattern, i) for i in (1, 2, 3)]
    return paths.filter(F.col("path").rlike(pattern)).select(F.concat_ws("-", *parts).alias("date")).distinct()


def upsert(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], updated_at: str | None = None) -> DataFrame:
    """Inserts source rows and overwrites the named columns where the key is there; other columns stay."""
    right = source.select(*[F.col(c).alias(f"s_{c}") for c in keys + columns], F.lit(True).alias("s_hit"))
    on = [target[k] == right[f"s_{k}"] for k in keys]
    both = target.withColumn("t_hit", F.lit(True)).join(right, on, "full_outer")
    hit = F.col("s_hit").isNotNull()
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"s_{c}")).alias(c))
        elif c in columns:
            out.append(F.when(hit, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and updated_at:
            out.append(F.when(hit, F.lit(updated_at).cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Adds source rows whose key isn't there, one of each key."""
    return target.unionByName(source.dropDuplicates(keys).join(target, keys, "left_anti").select(target.columns))


def replace_children(target: DataFrame, new: DataFrame, keywords: DataFrame, version: str = "local_v1.0") -> DataFrame:
    """Mappings of the batch's news are replaced; keywords without an id are dropped."""
    kept = target.join(new.select("news_id").distinct(), "news_id", "left_anti")
    made = new.join(keywords, "keyword").select("news_id", "keyword_id", F.lit(version).alias("extractor_version"), F.lit(1.0).alias("weight")).distinct()
    return kept.unionByName(made)


def update_only(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], updated_at: str | None = None) -> DataFrame:
    """Overwrites columns where the key is in the source, with nulls too; inserts nothing."""
    right = source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("s_hit"))
    joined = target.join(right, keys, "left")
    hit = F.col("s_hit").isNotNull()
    new = {c: F.col(f"s_{c}") for c in columns}
    if updated_at and "updated_at" in target.columns:
        new.setdefault("updated_at", F.lit(updated_at).cast(target.schema["updated_at"].dataType))
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns])


def load_batch(tables: dict[str, DataFrame], batch: dict[str, DataFrame], version: str = "local_v1.0") -> dict[str, DataFrame]:
    """C4: the tables after a batch, loaded in the order keywords, refined, analysis, stocks, mentions.

    Tables are keywords (keyword, keyword_id, ...), news, news_stock and news_keyword; parts
    that the batch lacks leave theirs alone. Mappings find the keywords that the same batch
    brought. An analysis without a sentiment or summary column sets the neutral one and ''.
    """
    out = dict(tables)
    given = lambda part, keys: [c for c in batch[part].columns if c not in keys]
    if "keywords" in batch:
        out["keywords"] = upsert(out["keywords"], batch["keywords"], ["keyword"], given("keywords", ["keyword"]))
    if "refined" in batch:
        out["news"] = upsert(out["news"], batch["refined"], ["news_id"], given("refined", ["news_id"]))
    if "analysis" in batch:
        blank = {"summary": F.lit(""), "sentiment": F.lit("중립")}
        said = batch["analysis"].withColumns({c: v for c, v in blank.items() if c not in batch["analysis"].columns})
        out["news"] = update_only(out["news"], said, ["news_id"], list(blank))
    if "stocks" in batch:
        rows = batch["stocks"]
        stay = out["news_stock"].join(rows.select("news_id").distinct(), "news_id", "left_anti")
        out["news_stock"] = stay.unionByName(rows.select("news_id", "stock_id", F.lit(version).alias("extractor_version"), F.lit(1.0).alias("weight")).distinct())
    if "mentions" in batch:
        out["news_keyword"] = replace_children(out["news_keyword"], batch["mentions"], out["keywords"].select("keyword", "keyword_id"), version)
    return out


def guarded_update(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets titles from (news_id, old_title, new_title) where the title still is the old one."""
    joined = target.join(changes, "news_id", "left")
    return joined.select(*[F.when(F.col("title") == F.col("old_title"), F.col("new_title")).otherwise(F.col("title")).alias(c) if c == "title" else F.col(c) for c in target.columns])


def transition_status(target: DataFrame, ids: DataFrame, status: str, version: str, reason: str, at: str, allowed: list[str] | None = None) -> DataFrame:
    """Sets the status of ids, where given only from allowed ones."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    hit = F.col("s_hit").isNotNull()
    if allowed is not None:
        hit = hit & F.col("filter_status").isin(allowed)
    joined = target.join(ids.select("news_id").distinct().withColumn("s_hit", F.lit(True)), "news_id", "left").withColumn("s_do", hit)
    new = {"filter_status": F.lit(status), "filter_version": F.lit(version), "filter_reason": F.lit(reason), "filtered_at": F.lit(at).cast("timestamp_ntz")}
    return joined.select(*[F.when(F.col("s_do"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns])


def retention(snapshots: DataFrame, snapshot_at: str, days: int = 7) -> DataFrame:
    """Snapshots of the last days."""
    return snapshots.filter(F.col("snapshot_at") >= F.lit(snapshot_at).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))


def full_article_view(refined: DataFrame, articles: DataFrame, crawled: DataFrame) -> DataFrame:
    """Refined articles with everything known about them."""
    return refined.join(articles, "news_id").join(crawled, "news_id")


def fill_experiment_columns(serves: DataFrame) -> DataFrame:
    """Experiment and variant where blank; the variant follows the source's name, in which ``_`` is any character."""
    named = F.when(F.col("source").like("ab_latest_%"), "latest").when(F.col("source").like("ab_popular_%"), "popular").when(F.col("source").like("ab_random_%"), "random").otherwise("recommend")
    return serves.withColumns({"experiment_id": F.coalesce(F.nullif("experiment_id", F.lit("")), F.lit("control")), "variant": F.coalesce(F.nullif("variant", F.lit("")), named)})


def select_missing_embeddings(rows: DataFrame, vector: str, text: str | None = None, refresh: bool = False) -> DataFrame:
    """Rows to encode: with a text where one is named, without a vector unless all are refreshed."""
    out = rows.filter(F.col(text).isNotNull()) if text else rows
    return out if refresh else out.filter(F.col(vector).isNull())


def advance_crawl_status(articles: DataFrame, blocked: Column, results: DataFrame, version: str) -> DataFrame:
    """Pending articles are url_filtered or get the list's version and are crawled; a result without text failed.

    ``results`` has (news_id, text) of crawls; an article that is pending with a version and has no result stays so.
    """
    joined = articles.join(results.select("news_id", F.col("text").alias("r_text"), F.lit(True).alias("r_hit")), "news_id", "left")
    pending = F.col("crawl_status") == "pending"
    tried = pending & ~blocked & F.col("r_hit").isNotNull()
    status = F.when(pending & blocked, "url_filtered").when(tried & (F.trim(F.coalesce("r_text", F.lit(""))) != ""), "crawl_success").when(tried, "crawl_failed").otherwise(F.col("crawl_status"))
    new = {"crawl_status": status, "url_filter_version": F.when(pending, F.lit(version)).otherwise(F.col("url_filter_version")), "crawl_attempt_count": F.col("crawl_attempt_count") + tried.cast("int")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in articles.columns])
