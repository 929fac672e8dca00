"""Queries for C4, F13, F18 and the parts of 2.J by label: batch loads, assembled pages and serving logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import CURSOR_REASONS
from millrace.operators import behaviour as d
from millrace.operators import lake
from millrace.operators import monitoring as m
from millrace.operators import retrieval as r
from millrace.plans import behaviour as bq
from millrace.plans import evaluate as hq
from millrace.plans import retrieval as rq
from millrace.plans import text as tq
from millrace.plans.behaviour import SQL_D
from millrace.plans.evaluate import SQL_J, ntz, six
from millrace.plans.retrieval import SQL_R
from millrace.plans.text import ANSWERS_SQL, SQL_T
from millrace.sources import adapters as a
from millrace.sources.adapters import END, START

POLICY = {"onboarding": 2, "behavior": 2, "breaking": 1, "popular": 1}


def _load(s, p):
    """A batch of all five parts over articles, texts and answers of the given tables."""
    brands = a.read(s, p, "part").groupBy(F.col("p_brand").alias("keyword")).agg(F.min("p_partkey").alias("keyword_id"))
    docs = tq.docs(s, p).select("news_id", F.col("text").alias("refined_text"), "lang")
    old = docs.filter("lang <> 'fr'").select("news_id", "refined_text", F.lit("old").alias("summary"), F.lit("old").alias("sentiment"))
    finished = a.articles(s, p).filter("o_orderstatus = 'F'").select("news_id")
    tables = {
        "keywords": brands, "news": old, "news_stock": a.news_stock(s, p).select("news_id", "stock_id", F.lit("old").alias("extractor_version"), F.lit(0.5).alias("weight")),
        "news_keyword": a.news_stock(s, p).select("news_id", F.col("stock_id").alias("keyword_id"), F.lit("old").alias("extractor_version"), F.lit(1.0).alias("weight")),
    }
    batch = {
        "keywords": brands.filter("keyword > 'Brand#5'").select("keyword", F.lit(1).cast("long").alias("keyword_id")),
        "refined": docs.filter("lang <> 'de'").select("news_id", F.concat("lang", F.lit(":"), "refined_text").alias("refined_text")),
        "analysis": tq._parsed(s, p).filter("attempt = 0").select("news_id", "summary", "sentiment"),
        "stocks": a.news_stock(s, p).join(finished, "news_id", "left_semi").select("news_id", (F.col("stock_id") + 1).alias("stock_id")),
        "mentions": a.news_keyword(s, p).join(finished, "news_id", "left_semi"),
    }
    return lake.load_batch(tables, batch)


def _assembled(s, p):
    served = rq.fixed(s, p).filter("pos < 15")
    return r.assemble_timeline(served.drop("path"), served.filter("path <> 'popular'"), rq.fixed(s, p).filter("pos >= 10"))


def _request_rows(s, p):
    ratio = F.create_map(*[F.lit(x) for pair in POLICY.items() for x in pair])
    sessions = rq._sessions(s, p).select("user_id", "request_id", "offset", F.when(F.col("user_id") % 3 == 0, "hit").otherwise("miss").alias("cache_status"), ratio.alias("mix_ratio"))
    rows = r.request_rows(sessions, rq.lists(s, p), rq.fixed(s, p).filter("pos < 20"))
    return rows.withColumn("mix_ratio", F.array_join(F.transform(F.map_entries("mix_ratio"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


def _shown(s, p):
    """Impressions with the time, experiment and variant of their request."""
    items = d.explode_served_items(a.serves(s, p), START, END).select("id", "request_id", "user_id", "news_id", "path", F.col("position").alias("rank"))
    kind = F.when(F.col("user_id") % 5 == 0, "latest").otherwise("recommend")
    return items.join(a.serves(s, p).select("id", F.col("created_at").alias("ts")), "id").withColumns({"experiment_id": F.lit("exp"), "variant": kind})


def _impression_lines(s, p):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp")
    fields = F.struct(at, "request_id", F.col("request_id").alias("session_id"), "user_id", "news_id", "rank", "path", F.lit(1).alias("batch_generation_id"), "experiment_id", "variant")
    lines = _shown(s, p).select(F.concat(F.lit("INFO recommend_impression "), F.to_json(fields)).alias("value"))
    return lines.unionByName(hq.log_lines(s, p))  # the other kind of line is left out


def _requests(s, p):
    """The request log with reasons of its fallbacks and states of its prefetches."""
    i = F.col("latency_ms")
    return hq.requests(s, p).withColumns({
        "fallback_reason": F.when(F.col("fallback_used") & (i % 3 > 0), F.when(i % 3 == 1, "popular pool empty").otherwise("stale_session_restored")),
        "prefetch_triggered": i % 5 < 2, "prefetch_status": F.when(i % 5 == 0, "ready").when(i % 5 == 1, "failed"), "prefetch_trigger_path": F.when(i % 2 == 0, "breaking"),
    })


def _states(s, p):
    return a.serves(s, p).select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 2 == 0, "warm").otherwise("cold").alias("user_state"))


def _cursor_errors(s, p):
    """Texts of conversations as messages of cursor errors, one each seven minutes."""
    rows = a.read(s, p, "conversations", "conv_id", "turn", "text").filter("conv_id IS NOT NULL")
    at = (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("conv_id") * 7)).alias("ts")
    message = F.concat(F.element_at(F.array(*map(F.lit, ("bad format ", "limit differs ", ""))), (F.col("turn") % 3 + 1).cast("int")), F.coalesce("text", F.lit("")))
    return m.cursor_errors(rows.select(at, F.lit("exp").alias("experiment_id"), F.lit("v").alias("variant"), message.alias("message")))


SHOWN = """, shown AS (SELECT i.*, position AS rank, created_at AS ts, 'exp' AS experiment_id, CASE WHEN user_id % 5 = 0 THEN 'latest' ELSE 'recommend' END AS variant FROM items i)"""
REQ = """, rq AS (SELECT *, CASE WHEN fallback_used AND latency_ms % 3 > 0 THEN CASE WHEN latency_ms % 3 = 1 THEN 'popular_pool_empty' ELSE 'stale_session_restored' END END AS reason,
  latency_ms % 5 < 2 AS triggered, CASE latency_ms % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' END AS prefetch FROM wins)"""
LOADED = ", brand AS (SELECT p_brand AS keyword, min(p_partkey) AS id FROM part GROUP BY 1), fin AS (SELECT news_id FROM articles WHERE o_orderstatus = 'F')"
QUERIES = {
    "c04_load_batch": lambda s, p: _load(s, p)["news_keyword"],
    "c04_loaded_keywords": lambda s, p: _load(s, p)["keywords"],
    "c04_loaded_news": lambda s, p: _load(s, p)["news"],
    "c04_loaded_stocks": lambda s, p: _load(s, p)["news_stock"],
    "e13_pair_weight": lambda s, p: rq.vectors(s, p).select(F.lower("type").alias("type"), "id", F.explode(F.array(F.lit("stock"), F.lit("keyword"))).alias("other")).withColumn("weight", r.pair_weight(F.col("type"), F.col("other"))),
    "f13_assemble_timeline": _assembled,
    "f18_request_rows": _request_rows,
    "j01_parse_impression_log": lambda s, p: ntz(m.parse_impression_log(_impression_lines(s, p)), "ts").select("request_id", "session_id", "user_id", "news_id", "rank", "path", "batch_generation_id", "experiment_id", "variant", "ts"),
    "j02_event_counters": lambda s, p: ntz(m.event_counters(_requests(s, p)), "window_start"),
    "j02_path_items": lambda s, p: ntz(m.label_mix(_shown(s, p), "path"), "window_start").select("window_start", F.col("label").alias("path"), "count"),
    "j02_cursor_errors": lambda s, p: ntz(_cursor_errors(s, p), "window_start"),
    "j04_path_mix": lambda s, p: ntz(six(m.label_mix(_shown(s, p), "path", 1440), "rate"), "window_start"),
    "j04_status_mix": lambda s, p: ntz(six(m.label_mix(_requests(s, p).withColumn("status", F.when(F.col("error"), 500).otherwise(200)), "status", 60), "rate"), "window_start"),
    "j06_session_metrics": lambda s, p: six(m.session_metrics(_shown(s, p), bq._opens(s, p), _states(s, p)), "first_click_rate", "clicks_per_session", "ctr"),
    "j06_request_metrics": lambda s, p: six(m.request_metrics(_requests(s, p), "user_state", "variant"), "cache_hit_rate", "fallback_rate", "prefetch_success_rate"),
    "j06_allocation_share": lambda s, p: six(m.allocation_share(_shown(s, p), "variant"), "share"),
}
ORACLES = {
    "c04_load_batch": SQL_T + LOADED + """ SELECT news_id, stock_id AS keyword_id, 'old' AS extractor_version, 1.0::DOUBLE AS weight FROM news_stock WHERE news_id NOT IN (SELECT news_id FROM news_keyword SEMI JOIN fin USING (news_id))
    UNION ALL SELECT DISTINCT news_id, CASE WHEN keyword > 'Brand#5' THEN 1 ELSE b.id END, 'local_v1.0', 1.0::DOUBLE FROM news_keyword JOIN fin USING (news_id) JOIN brand b USING (keyword)""",
    "c04_loaded_keywords": SQL_T + LOADED + " SELECT keyword, CASE WHEN keyword > 'Brand#5' THEN 1 ELSE id END AS keyword_id FROM brand",
    "c04_loaded_news": SQL_T + ", " + ANSWERS_SQL + """, an AS (SELECT news_id, CASE WHEN had THEN summary ELSE '' END AS summary, CASE WHEN had THEN sentiment ELSE '' END AS sentiment FROM said WHERE attempt = 0)
    SELECT news_id, CASE WHEN lang <> 'de' THEN lang || ':' || text ELSE text END AS refined_text, CASE WHEN an.news_id IS NOT NULL THEN an.summary WHEN lang <> 'fr' THEN 'old' END AS summary, CASE WHEN an.news_id IS NOT NULL THEN an.sentiment WHEN lang <> 'fr' THEN 'old' END AS sentiment
    FROM docs LEFT JOIN an USING (news_id) WHERE lang IS NOT NULL""",
    "c04_loaded_stocks": SQL_T + LOADED + " SELECT news_id, stock_id, 'old' AS extractor_version, 0.5::DOUBLE AS weight FROM news_stock ANTI JOIN fin USING (news_id) UNION ALL SELECT news_id, stock_id + 1, 'local_v1.0', 1.0::DOUBLE FROM news_stock SEMI JOIN fin USING (news_id)",
    "e13_pair_weight": SQL_R + " SELECT v.type, v.id, other, CASE WHEN v.type <> other THEN 0.9 WHEN v.type = 'stock' THEN 1.15 ELSE 1.0 END::DOUBLE AS weight FROM vec v, (VALUES ('stock'), ('keyword')) o(other)",
    "f13_assemble_timeline": SQL_R + " SELECT user_id, pos, news_id, CASE WHEN pos < 15 AND path = 'popular' THEN 'unknown' ELSE path END AS path FROM fixed",
    "f18_request_rows": SQL_R + """, sess AS (SELECT user_id, min(request_id) AS request_id FROM served GROUP BY 1), rest AS (SELECT * FROM lists l WHERE NOT EXISTS (SELECT 1 FROM fixed f WHERE f.user_id = l.user_id AND f.news_id = l.news_id AND f.pos < 20))
    SELECT user_id, request_id, 10 AS "offset", CASE WHEN user_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS cache_status, 'onboarding:2,behavior:2,breaking:1,popular:1' AS mix_ratio,
      count(path) FILTER (path = 'onboarding') AS onboarding_remaining, count(path) FILTER (path = 'behavior') AS behavior_remaining, count(path) FILTER (path = 'breaking') AS breaking_remaining, count(path) FILTER (path = 'popular') AS popular_remaining
    FROM sess LEFT JOIN rest USING (user_id) GROUP BY user_id, request_id""",
    "j01_parse_impression_log": SQL_D + SHOWN + " SELECT request_id, request_id AS session_id, user_id, news_id, rank, path, 1 AS batch_generation_id, experiment_id, variant, ts FROM shown",
    "j02_event_counters": SQL_J + REQ + """, ev2 AS (SELECT window_start, user_state, variant, 'requests' AS counter, CASE WHEN error THEN 'error' ELSE 'success' END AS label FROM rq
    UNION ALL SELECT window_start, user_state, variant, 'cache', cache_status FROM rq WHERE NOT error UNION ALL SELECT window_start, user_state, variant, 'fallback', coalesce(reason, 'unknown') FROM rq WHERE NOT error AND fallback_used
    UNION ALL SELECT window_start, user_state, variant, 'prefetch', prefetch || ':' || CASE WHEN latency_ms % 2 = 0 THEN 'breaking' ELSE 'none' END FROM rq WHERE NOT error AND prefetch IS NOT NULL)
    SELECT window_start, user_state, 'exp' AS experiment_id, variant, counter, label, count(*) AS count FROM ev2 GROUP BY ALL""",
    "j02_path_items": SQL_D + SHOWN + " SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, path, count(*) AS count FROM shown GROUP BY ALL",
    "j02_cursor_errors": f"""SELECT time_bucket(INTERVAL 5 MINUTE, TIMESTAMP '{START}' + to_minutes(conv_id * 7)) AS window_start, 'exp' AS experiment_id, 'v' AS variant, CASE """
    + " ".join(f"WHEN contains(x, '{k}') THEN '{v}'" for k, v in CURSOR_REASONS) + """ ELSE 'invalid_cursor' END AS reason, count(*) AS count
    FROM (SELECT *, lower(['bad format ', 'limit differs ', ''][1 + turn % 3] || coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY ALL""",
    "j04_path_mix": SQL_D + SHOWN + " SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, path AS label, count(*) AS count, round(count(*) / 86400.0 / greatest(sum(count(*)) OVER (PARTITION BY date_trunc('day', ts)) / 86400.0, 1), 6) AS rate FROM shown GROUP BY date_trunc('day', ts), path",
    "j04_status_mix": SQL_J + " SELECT date_trunc('hour', ts) AS window_start, CASE WHEN error THEN '500' ELSE '200' END AS label, count(*) AS count, round(count(*) / 3600.0 / greatest(sum(count(*)) OVER (PARTITION BY date_trunc('hour', ts)) / 3600.0, 1), 6) AS rate FROM wins GROUP BY date_trunc('hour', ts), error",
    "j06_session_metrics": SQL_D + """, each AS (SELECT request_id, user_id, count(*) AS shown, count(o.request_id) AS clicks FROM items LEFT JOIN (SELECT DISTINCT request_id, user_id, news_id FROM opens) o USING (request_id, user_id, news_id) GROUP BY ALL)
    SELECT CASE WHEN user_id % 2 = 0 THEN 'warm' ELSE 'cold' END AS user_state, count(*) AS sessions, round(avg((clicks > 0)::INT), 6) AS first_click_rate, round(avg(clicks), 6) AS clicks_per_session, round(sum(clicks) / sum(shown), 6) AS ctr FROM each GROUP BY 1""",
    "j06_request_metrics": SQL_J + REQ + """ SELECT user_state, variant, count(*) AS requests, round(avg((cache_status = 'hit')::INT), 6) AS cache_hit_rate, round(avg(fallback_used::INT), 6) AS fallback_rate, round(count(*) FILTER (triggered AND prefetch = 'ready') / count(*) FILTER (triggered), 6) AS prefetch_success_rate,
    quantile_cont(latency_ms, 0.5) AS latency_p50, quantile_cont(latency_ms, 0.95) AS latency_p95 FROM rq GROUP BY ALL""",
    "j06_allocation_share": SQL_D + SHOWN + " SELECT variant, path, count(*) AS items, round(count(*) / sum(count(*)) OVER (PARTITION BY variant), 6) AS share FROM shown GROUP BY variant, path",
}
