"""Queries for large tables in parts and the hash registry (A14, A17, B16) and for long block lists (B2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import funnel, parts
from millrace.plans.keep import folder, kept
from millrace.plans.text import SQL_T, art, batch
from millrace.sources import adapters as a


def _changes(s, p):
    """Titles by their orders' totals: urgent articles are changed, those of high priority have ids that are new."""
    rows = a.articles(s, p).filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    shifted = F.col("news_id") + F.when(F.col("o_orderpriority") == "2-HIGH", 1_000_000_000).otherwise(0)
    return rows.select(shifted.alias("news_id"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("N"), F.col("o_custkey").cast("string"))).alias("title"))


CHANGES = """,
chg AS (SELECT news_id + CASE WHEN o_orderpriority = '2-HIGH' THEN 1000000000 ELSE 0 END AS news_id,
  CASE WHEN o_orderstatus <> 'F' THEN 'N' || o_custkey END AS title FROM articles WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
"""
TITLE = "CASE WHEN c.news_id IS NULL THEN a.title ELSE c.title END AS title"


def _in_parts(insert):
    def query(s, p):
        table, path = art(s, p), folder(s, "news-parts")
        parts.write_parts(table, path, ["news_id"])
        parts.upsert_parts(s, path, table.schema, kept(_changes(s, p)), ["news_id"], ["title"], insert=insert)
        return parts.read_parts(s, path, table.schema).select(table.columns)

    return query


def _across_runs(s, p):
    """Three runs, by the documents' sources in order; each asks the registry of the runs before and adds to it."""
    path, out = folder(s, "registry"), None
    runs = batch(s, p).withColumn("run", F.pmod(F.length("source"), F.lit(3))).filter("run IS NOT NULL")
    rows = kept(runs.select("news_id", "run", "created_at", t.content_hash(F.col("text")).alias("content_hash")))
    for run in range(3):
        first = rows.filter(F.col("run") == run).groupBy("run", "content_hash").agg(F.min(F.struct("created_at", "news_id"))["news_id"].alias("news_id"))
        known = parts.registered(s, path, first, before=run)
        new = kept(first.join(known, "content_hash", "left_anti"))
        parts.register(new, path, run)
        out = new if out is None else out.unionByName(new)
    return out.select("news_id", "run", "content_hash")


def _domains(s, p):
    return a.read(s, p, "pages", "page_id", "url").select("page_id", t.url_domain(F.col("url")).alias("domain"))


def _listed(s, p):
    """A long list: names out of the hosts of pages in German, and the sources of documents."""
    hosts = a.read(s, p, "pages", "url").filter(F.col("url").contains("/de/")).select(t.url_domain(F.col("url")).alias("domain"))
    names = hosts.select(F.explode(F.split("domain", "[.]")).alias("listed")).filter("listed NOT IN ('example', 'com', 'net', 'org', 'm')")
    return names.unionByName(a.read(s, p, "documents", F.col("source").alias("listed"))).distinct()


LISTED = """,
hosts AS (SELECT DISTINCT domain FROM pg WHERE contains(url, '/de/')),
listed AS (SELECT DISTINCT n AS listed FROM (SELECT unnest(string_split(domain, '.')) AS n FROM hosts) WHERE n NOT IN ('example', 'com', 'net', 'org', 'm')
  UNION SELECT DISTINCT source FROM documents WHERE source IS NOT NULL),
hit AS (SELECT DISTINCT d.domain FROM (SELECT DISTINCT domain FROM pg) d JOIN listed l ON contains(d.domain, l.listed) OR contains(l.listed, d.domain))
"""

QUERIES = {
    "a14_upsert_parts": _in_parts(True),
    "a17_update_parts": _in_parts(False),
    "b16_registry_runs": _across_runs,
    "b02_long_list": lambda s, p: funnel.domain_blocklist(_domains(s, p), _listed(s, p), True),
    "b02_long_list_rest": lambda s, p: funnel.domain_blocklist(_domains(s, p), _listed(s, p), False),
}
ORACLES = {
    "a14_upsert_parts": SQL_T + CHANGES + f"""SELECT news_id, a.pub_date, {TITLE}, a.source
FROM art a FULL JOIN chg c USING (news_id)""",
    "a17_update_parts": SQL_T + CHANGES + f"SELECT news_id, a.pub_date, {TITLE}, a.source FROM art a LEFT JOIN chg c USING (news_id)",
    "b16_registry_runs": SQL_T + """SELECT news_id, (length(source) % 3)::INT AS run, content_hash FROM hashed WHERE source IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY length(source) % 3, created_at, news_id) = 1""",
    "b02_long_list": SQL_T + LISTED + "SELECT page_id, domain FROM pg WHERE domain IN (SELECT domain FROM hit)",
    "b02_long_list_rest": SQL_T + LISTED + "SELECT page_id, domain FROM pg WHERE domain NOT IN (SELECT domain FROM hit)",
}
