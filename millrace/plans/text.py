"""Queries for 2.A, 2.B and 2.C."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import funnel, lake
from millrace.sources import adapters as a
from millrace.sources.adapters import END, SQL

# The given texts have no Korean; these words and letters of theirs make every branch occur.
SPORTS, CONTEXT, SCRIPT = ("des", "nicht", "onat"), ("the", "der", "les", "que", "und", "con", "are"), "[éüß]"
TERMS, UNWANTED = ("that", "für", "dans", "para", "from", "which"), ("disgusting", "idiot")
DOMAINS = ("blog.ththan.example.net", "example.org", "m.")
JSON_KEYS = ("analysis", "result", "data")


def docs(s, p):
    return a.read(s, p, "documents", "doc_id", "text", "lang", "source").withColumnRenamed("doc_id", "news_id")


def pages(s, p):
    return a.read(s, p, "pages")


def batch(s, p):
    """Documents as crawled rows, with a time and a status."""
    statuses = F.array(*map(F.lit, ("pending", "processing", "passed", "failed_retryable")))
    return docs(s, p).withColumns({
        "created_at": (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("news_id") * 7)).cast("timestamp_ntz"),
        "filter_status": F.element_at(statuses, (F.col("news_id") % 4 + 1).cast("int")), "filter_version": F.lit("v0"), "filter_reason": F.lit(None).cast("string"), "filtered_at": F.lit(None).cast("timestamp_ntz"),
    })


SQL_T = SQL + """,
docs AS (SELECT doc_id AS news_id, text, lang, source FROM documents),
batch AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(news_id * 7) AS created_at, ['pending', 'processing', 'passed', 'failed_retryable'][1 + news_id % 4] AS filter_status, 'v0' AS filter_version, NULL::VARCHAR AS filter_reason, NULL::TIMESTAMP AS filtered_at FROM docs),
hashed AS (SELECT *, CASE WHEN text IS NULL THEN '' ELSE md5(translate(text, ' ' || chr(10) || chr(13) || chr(9), '')) END AS content_hash FROM batch),
art AS (SELECT news_id, pub_date, 'T' || (news_id % 50) || CASE WHEN news_id % 3 = 0 THEN '...' ELSE '' END AS title, o_orderpriority AS source FROM articles),
pg AS (SELECT page_id, url, html, replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), 'www.', '') AS domain FROM pages)
"""


def _registry(s, p):
    return docs(s, p).filter("lang = 'fr'").select(t.content_hash(F.col("text")).alias("content_hash")).distinct()


def art(s, p):
    title = F.concat(F.lit("T"), (F.col("news_id") % 50).cast("string"), F.when(F.col("news_id") % 3 == 0, "...").otherwise(""))
    return a.articles(s, p).select("news_id", "pub_date", title.alias("title"), F.col("o_orderpriority").alias("source"))


def _changes(s, p):
    """New values for every other article, and some that aren't there."""
    rows = art(s, p).filter("news_id % 2 = 0").select((F.col("news_id") + F.when(F.col("news_id") % 8 == 0, 1_000_000_000).otherwise(0)).alias("news_id"), "pub_date", F.when(F.col("news_id") % 6 != 0, F.concat(F.lit("N"), "title")).alias("title"), "source")
    return rows


CHANGES = "chg AS (SELECT news_id + CASE WHEN news_id % 8 = 0 THEN 1000000000 ELSE 0 END AS news_id, pub_date, CASE WHEN news_id % 6 <> 0 THEN 'N' || title END AS title, source FROM art WHERE news_id % 2 = 0)"


def _refine(s, p):
    text = F.coalesce("text", F.lit(""))
    return funnel.refine(batch(s, p), _registry(s, p), text, t.is_sports(F.col("text"), SPORTS, CONTEXT))


SPORT_SQL = "(" + " OR ".join(f"contains(low, '{w}')" for w in SPORTS) + ") AND " + " + ".join(f"contains(low, '{w}')::INT" for w in CONTEXT) + " >= 3"
REFINE_SQL = f"""refined AS (SELECT news_id, coalesce(text, '') AS refined_text, content_hash,
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' WHEN nth > 1 THEN 'duplicate_in_batch' WHEN content_hash IN (SELECT content_hash FROM hashed WHERE lang = 'fr') THEN 'duplicate_processed'
   WHEN ({SPORT_SQL}) OR length(coalesce(text, '')) <= 20 THEN 'sports_or_too_short' END AS reason
  FROM (SELECT *, lower(coalesce(text, '')) AS low, row_number() OVER (PARTITION BY trim(coalesce(text, '')) = '', content_hash ORDER BY created_at, news_id) AS nth FROM hashed))"""
STATUS_SQL = "CASE WHEN reason IN ('empty_text', 'sports_or_too_short') THEN 'filtered_out' WHEN reason IS NULL THEN 'passed' ELSE 'skipped' END AS status"


def _conversation_answers(s, p):
    """Texts of conversations as answers of a model, plain or nested by turn."""
    rows = a.read(s, p, "conversations", "conv_id", "turn", "text")
    mood = F.element_at(F.array(*map(F.lit, ("긍정", "중립", "부정", "??"))), (F.col("conv_id") % 4 + 1).cast("int"))
    answer = F.struct(F.when(F.col("turn") % 5 != 4, F.col("text")).otherwise("").alias("summary"), mood.alias("sentiment"), F.split("text", " ").alias("keywords"))
    raw = F.when(F.col("turn") % 3 == 0, F.to_json(answer)).when(F.col("turn") % 3 == 1, F.to_json(F.struct(answer.alias("analysis")))).otherwise(F.concat(F.lit("["), F.to_json(answer), F.lit("]")))
    return rows.select(F.col("conv_id").alias("news_id"), F.col("turn").alias("attempt"), F.when(F.col("turn") != 6, raw).alias("raw"))


ANSWERS_SQL = """said AS (SELECT conv_id AS news_id, turn AS attempt, turn <> 6 AS had, CASE WHEN turn % 5 <> 4 THEN trim(text, ' ') ELSE '' END AS summary,
  CASE WHEN conv_id % 4 = 3 THEN '' ELSE ['긍정', '중립', '부정'][1 + conv_id % 4] END AS sentiment, string_split(text, ' ') AS keywords FROM conversations)"""


def _parsed(s, p):
    return funnel.parse_enrichment(_conversation_answers(s, p))


def _counts(frame):
    return frame.groupBy("outcome").count()


def _crawled(s, p):
    return batch(s, p).select("news_id", "created_at", "text")


def _windows(s, p):
    """Rows of three processing windows that overlap in their news."""
    base = art(s, p)
    return base.withColumn("window_start", F.explode(F.expr("transform(sequence(0, news_id % 3), i -> concat('2026030', cast(9 - i as string), '0100'))")))


WINDOWS = "win AS (SELECT *, unnest(list_transform(range(0, news_id % 3 + 1), lambda i: '2026030' || (9 - i)::VARCHAR || '0100')) AS window_start FROM art)"


def _serves(s, p):
    return a.serves(s, p).select("id", "request_id", F.concat(F.element_at(F.array(*map(F.lit, ("ab_latest_", "ab_popular_", "ab_random_", "abXlatestXx", "main"))), (F.col("id") % 5 + 1).cast("int")), F.lit("cold")).alias("source"), F.when(F.col("id") % 2 == 0, "exp").otherwise("").alias("experiment_id"), F.when(F.col("id") % 3 == 0, "given").alias("variant"))


def names(s, p):
    return funnel.stock_name_map(a.read(s, p, "part").select(F.col("p_name").alias("stock_name"), F.col("p_partkey").alias("stock_id")), a.read(s, p, "supplier").select(F.col("s_name").alias("alias_name"), F.col("s_suppkey").alias("stock_id")))


def _said_names(s, p):
    return a.read(s, p, "part").select(F.col("p_partkey").alias("news_id"), F.array(F.concat(F.lit(" "), F.upper("p_name")), F.lit("nobody"), F.lit("red widget")).alias("related_stocks"))


def with_mentions(s, p):
    return a.read(s, p, "part").select(F.col("p_partkey").alias("news_id"), F.concat(F.lit("the "), F.upper("p_name"), F.lit(", and a Red Widget팀은 or red widget은.")).alias("text"))


NAMES = "names AS (SELECT name, arg_max(stock_id, (rank, stock_id)) AS stock_id FROM (SELECT lower(p_name) AS name, p_partkey AS stock_id, 0 AS rank FROM part UNION ALL SELECT lower(s_name), s_suppkey, 1 FROM supplier) GROUP BY name)"


def _post(s, p):
    stocks = a.news_stock(s, p).select("news_id")
    return funnel.post_filter(docs(s, p).select("news_id", "text"), stocks, TERMS, UNWANTED)


def _text(name, *columns):
    return lambda s, p: docs(s, p).select("news_id", *[c.alias(n) for n, c in ((name, c) for c in columns)])


def _crawl(s, p):
    base = art(s, p).withColumns({"crawl_status": F.when(F.col("news_id") % 4 != 1, "pending").otherwise("crawl_success"), "url_filter_version": F.lit(None).cast("string"), "crawl_attempt_count": F.lit(0)}).select("news_id", "source", "crawl_status", "url_filter_version", "crawl_attempt_count")
    results = art(s, p).filter("news_id % 3 <> 2").select("news_id", F.when(F.col("news_id") % 3 == 0, F.lit(" ")).otherwise(F.col("title")).alias("text"))
    return lake.advance_crawl_status(base, F.col("source") == "5-LOW", results, "v1.00")


def _titles(s, p):
    rows = art(s, p).withColumns({"crawl_status": F.when(F.col("news_id") % 5 == 0, "url_filtered").otherwise(F.lit(None)), "api_request_date": F.col("pub_date")})
    found = art(s, p).select("news_id", F.when(F.col("news_id") % 2 == 0, F.concat("title", F.lit("  whole"))).when(F.col("news_id") % 4 == 1, F.col("title")).otherwise("").alias("new_title"))
    return funnel.title_backfill(rows, found, "2030-01-01 00:00:00", 36500, 2000)


q, o = {}, {}


def add(name, query, sql=None, ctes=()):
    q[name] = query
    if sql:
        o[name] = SQL_T + "".join(f",\n{c}" for c in ctes) + sql


add("a01_scan_window", lambda s, p: lake.scan_window(_crawled(s, p).select("news_id", "created_at"), art(s, p), "2024-01-01 09:00:00", "2099-01-01 00:00:00"),
    "SELECT news_id, created_at, pub_date, title, a.source FROM batch b JOIN art a USING (news_id) WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00'")
add("a02_scan_day", lambda s, p: lake.scan_day(_crawled(s, p).select("news_id", "created_at"), art(s, p), "2024-01-02"),
    "SELECT news_id, created_at, pub_date, title, a.source FROM batch b JOIN art a USING (news_id) WHERE created_at >= TIMESTAMP '2024-01-01 15:00:00' AND created_at <= TIMESTAMP '2024-01-02 14:59:59'")
add("a03_parse_search_items", lambda s, p: lake.parse_search_items(art(s, p).select(F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.date_format("pub_date", "EEE, dd MMM yyyy HH:mm:ss '+0900'").alias("pubDate"), F.when(F.col("news_id") % 2 == 0, "  ").otherwise(F.concat(F.lit(" http://o/"), F.col("news_id"))).alias("originallink"), F.concat(F.lit("http://l/"), F.col("news_id")).alias("link"), F.col("source").alias("search_keyword"))),
    "SELECT title, pub_date - INTERVAL 9 HOUR AS pub_date, CASE WHEN news_id % 2 = 0 THEN 'http://l/' ELSE 'http://o/' END || news_id AS url, source AS search_keyword FROM art")
add("a04_ingest_new_urls", lambda s, p: lake.ingest_new_urls(pages(s, p).select(F.col("page_id").alias("news_id"), "url"), batch(s, p).join(pages(s, p).select(F.col("page_id").alias("news_id"), "url"), "news_id").select("url", "created_at"), "2024-01-06 00:00:00"),
    "SELECT min(page_id) AS news_id, url FROM pg WHERE url NOT IN (SELECT g.url FROM pg g JOIN batch b ON b.news_id = g.page_id WHERE created_at >= TIMESTAMP '2024-01-03') GROUP BY url")
add("a06_explode_aliases", lambda s, p: lake.explode_aliases(a.read(s, p, "part").select(F.col("p_partkey").alias("stock_id"), F.concat(F.col("p_name"), F.lit(", ,"), F.upper("p_brand"), F.lit(" ,"), "p_name").alias("aliases"))),
    "SELECT DISTINCT p_partkey AS stock_id, unnest([p_name, upper(p_brand)]) AS alias_name FROM part")
add("a07_merge_partition", lambda s, p: lake.merge_partition(art(s, p), _changes(s, p)), "SELECT * FROM art WHERE news_id NOT IN (SELECT news_id FROM chg) UNION ALL SELECT * FROM chg", [CHANGES])
add("a09_scan_windows_of_day", lambda s, p: lake.scan_windows_of_day(_windows(s, p), "20260308"), "SELECT * FROM win WHERE window_start LIKE '20260308%'", [WINDOWS])
add("a10_merge_day", lambda s, p: lake.keep_last(_windows(s, p), ["news_id"], "window_start"), "SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY window_start DESC) = 1", [WINDOWS])
add("a11_latest_snapshot", lambda s, p: lake.latest_snapshot(a.articles(s, p).select(F.date_format("pub_date", "yyyyMMdd").alias("date")), "on_or_before", "19970101"), "SELECT max(strftime(pub_date, '%Y%m%d')) AS date FROM articles WHERE strftime(pub_date, '%Y%m%d') <= '19970101'")
add("a12_latest_before", lambda s, p: lake.latest_snapshot(a.articles(s, p).select(F.date_format("pub_date", "yyyyMMdd").alias("date")), "strictly_before", "19970101"), "SELECT max(strftime(pub_date, '%Y%m%d')) AS date FROM articles WHERE strftime(pub_date, '%Y%m%d') < '19970101'")
add("a13_list_date_partitions", lambda s, p: lake.list_date_partitions(a.articles(s, p).select(F.concat(F.lit("b/"), F.date_format("pub_date", "'year='yyyy'/month='MM'/day='dd"), F.lit("/x.parquet")).alias("path"))), "SELECT DISTINCT strftime(pub_date, '%Y-%m-%d') AS date FROM articles")
add("a14_upsert", lambda s, p: lake.upsert(art(s, p), _changes(s, p), ["news_id"], ["title"]),
    "SELECT news_id, a.pub_date, CASE WHEN c.news_id IS NULL THEN a.title ELSE c.title END AS title, a.source FROM art a FULL JOIN chg c USING (news_id)", [CHANGES])
add("a15_insert_if_absent", lambda s, p: lake.insert_if_absent(art(s, p), _changes(s, p), ["news_id"]), "SELECT * FROM art UNION ALL SELECT * FROM chg WHERE news_id NOT IN (SELECT news_id FROM art)", [CHANGES])
add("a16_replace_children", lambda s, p: lake.replace_children(a.news_stock(s, p).select("news_id", F.col("stock_id").alias("keyword_id"), F.lit("old").alias("extractor_version"), F.lit(0.5).alias("weight")), a.news_keyword(s, p).filter("news_id % 3 = 0"), a.read(s, p, "part").groupBy(F.col("p_brand").alias("keyword")).agg(F.min("p_partkey").alias("keyword_id")).filter("keyword_id % 2 = 0")),
    "SELECT news_id, stock_id AS keyword_id, 'old' AS extractor_version, 0.5::DOUBLE AS weight FROM news_stock WHERE news_id NOT IN (SELECT news_id FROM news_keyword WHERE news_id % 3 = 0) UNION ALL SELECT DISTINCT news_id, k.id, 'local_v1.0', 1.0 FROM news_keyword JOIN (SELECT p_brand AS keyword, min(p_partkey) AS id FROM part GROUP BY 1) k USING (keyword) WHERE news_id % 3 = 0 AND k.id % 2 = 0")
add("a17_update_only", lambda s, p: lake.update_only(art(s, p), _changes(s, p), ["news_id"], ["title"]), "SELECT news_id, a.pub_date, CASE WHEN c.news_id IS NULL THEN a.title ELSE c.title END AS title, a.source FROM art a LEFT JOIN chg c USING (news_id)", [CHANGES])
add("a18_guarded_update", lambda s, p: lake.guarded_update(art(s, p), art(s, p).filter("news_id % 2 = 0").select("news_id", F.when(F.col("news_id") % 4 == 0, F.col("title")).otherwise("other").alias("old_title"), F.lit("new").alias("new_title"))),
    "SELECT news_id, pub_date, CASE WHEN news_id % 4 = 0 THEN 'new' ELSE title END AS title, source FROM art")
add("a19_transition_status", lambda s, p: lake.transition_status(batch(s, p).drop("text", "lang", "source"), docs(s, p).filter("news_id % 2 = 0 OR news_id % 3 = 0"), "passed", "v2", "ok", END, ["pending", "failed_retryable"]),
    f"SELECT news_id, created_at, CASE WHEN hit THEN 'passed' ELSE filter_status END AS filter_status, CASE WHEN hit THEN 'v2' ELSE filter_version END AS filter_version, CASE WHEN hit THEN 'ok' END AS filter_reason, CASE WHEN hit THEN TIMESTAMP '{END}' END AS filtered_at FROM (SELECT *, (news_id % 2 = 0 OR news_id % 3 = 0) AND filter_status IN ('pending', 'failed_retryable') AS hit FROM batch)")
add("a20_retention", lambda s, p: lake.retention(a.articles(s, p).select("news_id", F.col("pub_date").alias("snapshot_at")), "1998-01-01 00:00:00", 365), "SELECT news_id, pub_date AS snapshot_at FROM articles WHERE pub_date >= TIMESTAMP '1997-01-01'")
add("a21_full_article_view", lambda s, p: lake.full_article_view(docs(s, p).select("news_id", F.col("text").alias("refined_text")), art(s, p), _crawled(s, p).select("news_id", "created_at")), "SELECT news_id, b.text AS refined_text, pub_date, title, a.source, created_at FROM batch b JOIN art a USING (news_id)")
add("a22_fill_experiment_columns", lambda s, p: lake.fill_experiment_columns(_serves(s, p)),
    "SELECT id, request_id, source, CASE WHEN id % 2 = 0 THEN 'exp' ELSE 'control' END AS experiment_id, CASE WHEN id % 3 = 0 THEN 'given' WHEN source LIKE 'ab_latest_%' THEN 'latest' WHEN source LIKE 'ab_popular_%' THEN 'popular' WHEN source LIKE 'ab_random_%' THEN 'random' ELSE 'recommend' END AS variant FROM (SELECT DISTINCT id, request_id, ['ab_latest_', 'ab_popular_', 'ab_random_', 'abXlatestXx', 'main'][1 + id % 5] || 'cold' AS source FROM served)")
add("a23_select_missing_embeddings", lambda s, p: lake.select_missing_embeddings(art(s, p).select("news_id", F.when(F.col("news_id") % 3 != 0, F.col("title")).alias("summary"), F.when(F.col("news_id") % 2 == 0, F.lit(1)).alias("vector")), "vector", "summary").select("news_id", "summary"), "SELECT news_id, title AS summary FROM art WHERE news_id % 3 <> 0 AND news_id % 2 = 1")
add("a24_advance_crawl_status", _crawl,
    "SELECT news_id, source, CASE WHEN NOT pending THEN 'crawl_success' WHEN source = '5-LOW' THEN 'url_filtered' WHEN news_id % 3 = 1 THEN 'crawl_success' WHEN news_id % 3 = 0 THEN 'crawl_failed' ELSE 'pending' END AS crawl_status, CASE WHEN pending THEN 'v1.00' END AS url_filter_version, (pending AND source <> '5-LOW' AND news_id % 3 <> 2)::INT AS crawl_attempt_count FROM (SELECT *, news_id % 4 <> 1 AS pending FROM art)")
add("b01_url_domain", lambda s, p: pages(s, p).select("page_id", t.url_domain(F.col("url")).alias("domain")), "SELECT page_id, domain FROM pg")
add("b02_domain_blocklist", lambda s, p: funnel.domain_blocklist(pages(s, p).select("page_id", t.url_domain(F.col("url")).alias("domain")), s.createDataFrame([(x,) for x in DOMAINS], "listed string"), True),
    "SELECT page_id, domain FROM pg WHERE " + " OR ".join(f"contains(domain, '{x}') OR contains('{x}', domain)" for x in DOMAINS))
add("b04_exact_domain_block", lambda s, p: funnel.exact_domain_block(pages(s, p).select("page_id", t.url_domain(F.col("url")).alias("domain")), list(DOMAINS)), "SELECT page_id, domain FROM pg WHERE domain NOT IN (" + ", ".join(f"'{x}'" for x in DOMAINS) + ")")
add("b05_titles", lambda s, p: art(s, p).select("news_id", t.normalize_title(F.concat(F.lit(" a\t\n "), "title")).alias("title"), t.is_truncated(F.col("title")).alias("cut")), "SELECT news_id, 'a ' || title AS title, title LIKE '%...' AS cut FROM art")
add("b06_html_title", lambda s, p: pages(s, p).select("page_id", funnel.html_title("html").alias("title")),
    "SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS title FROM pg")
add("b07_title_backfill", _titles,
    "SELECT news_id, title AS old_title, CASE WHEN news_id % 2 = 0 THEN title || ' whole' WHEN news_id % 4 = 1 THEN title ELSE '' END AS new_title, CASE WHEN news_id % 2 = 0 THEN 'updated' WHEN news_id % 4 = 1 THEN 'unchanged' ELSE 'failed' END AS outcome FROM art WHERE title LIKE '%...' AND news_id % 5 <> 0 ORDER BY pub_date DESC, news_id DESC LIMIT 2000")
add("b08_html_article_body", lambda s, p: pages(s, p).select("page_id", funnel.html_article_body(F.concat(F.lit("<div id='newsct_article'> one <b>two</b> <p> "), F.col("page_id").cast("string"), F.lit("</p></div>"), "html")).alias("body")), "SELECT page_id, 'one' || chr(10) || 'two' || chr(10) || page_id AS body FROM pg")
add("b09_html_stock_facts", lambda s, p: pages(s, p).select("page_id", funnel.html_stock_facts(F.concat(F.lit("<div class='x description'><img alt='KOSPI'></div><h4 class='h_sub sub_tit7'><em><a>Ind"), F.col("page_id").cast("string"), F.lit("</a></em></h4><div id='summary_info'><p>A</p><p> B </p></div>"))).alias("f")).select("page_id", "f.*"), "SELECT page_id, 'KOSPI' AS market, 'Ind' || page_id AS industry, 'A' || chr(10) || 'B' AS summary FROM pg")
add("b10_clean_text", lambda s, p: docs(s, p).select("news_id", t.clean_text(F.col("text")).alias("clean")))
add("b11_keep_script_sentences", lambda s, p: docs(s, p).select("news_id", t.keep_script_sentences(F.col("text"), SCRIPT).alias("kept")),
    f"SELECT news_id, CASE WHEN len(l) > 0 THEN array_to_string(l, '. ') || '.' ELSE '' END AS kept FROM (SELECT news_id, list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND regexp_matches(x, '{SCRIPT}')) AS l FROM docs)")
add("b12_is_sports", lambda s, p: docs(s, p).select("news_id", t.is_sports(F.col("text"), SPORTS, CONTEXT).alias("sports")), f"SELECT news_id, {SPORT_SQL} AS sports FROM (SELECT *, lower(text) AS low FROM docs)")
add("b13_is_short", lambda s, p: docs(s, p).select("news_id", t.is_short(F.col("text")).alias("short")), "SELECT news_id, length(text) <= 20 AS short FROM docs")
add("b14_content_hash", lambda s, p: docs(s, p).select("news_id", t.content_hash(F.col("text")).alias("content_hash")), "SELECT news_id, content_hash FROM hashed")
add("b15_dedup_in_batch", lambda s, p: funnel.dedup_in_batch(batch(s, p)).select("news_id", "content_hash", "is_first"), "SELECT news_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, news_id) = 1 AS is_first FROM hashed")
add("b16_dedup_across_runs", lambda s, p: funnel.dedup_across_runs(funnel.dedup_in_batch(batch(s, p)).filter("is_first"), _registry(s, p))[0].select("news_id", "content_hash"),
    "SELECT news_id, content_hash FROM (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY created_at, news_id) = 1) WHERE content_hash NOT IN (SELECT content_hash FROM hashed WHERE lang = 'fr')")
add("b17_refine", lambda s, p: _refine(s, p).drop("refined_text"), f"SELECT news_id, content_hash, reason, {STATUS_SQL} FROM refined", [REFINE_SQL])
add("b18_classify_error", lambda s, p: docs(s, p).select("news_id", t.failure(F.when(F.col("news_id") % 5 != 0, F.concat(F.when(F.col("news_id") % 3 == 0, "Bad Schema ").otherwise("x "), "text"))).alias("f")).select("news_id", "f.*"),
    "SELECT news_id, CASE WHEN news_id % 5 = 0 THEN 'refinement_error' ELSE substr(m, 1, 100) END AS reason, CASE WHEN news_id % 5 <> 0 AND regexp_matches(lower(m), 'invalid input syntax|undefined column|does not exist|enum|schema') THEN 'failed_permanent' ELSE 'failed_retryable' END AS status FROM (SELECT news_id, CASE WHEN news_id % 3 = 0 THEN 'Bad Schema ' ELSE 'x ' END || text AS m FROM docs)")
add("b19_refine_full_refresh", lambda s, p: funnel.refine_full_refresh(docs(s, p), F.col("text"), t.is_sports(F.col("text"), SPORTS, CONTEXT)),
    f"""SELECT news_id, 'duplicate_or_nan' AS outcome FROM u WHERE nth > 1 UNION ALL SELECT news_id, 'sports_news' FROM u WHERE nth = 1 AND sport UNION ALL SELECT news_id, 'short_text' FROM u WHERE nth = 1 AND length(text) <= 20 UNION ALL SELECT news_id, 'kept' FROM u WHERE nth = 1 AND NOT sport AND length(text) > 20""",
    [f"u AS (SELECT news_id, text, nth, {SPORT_SQL} AS sport FROM (SELECT *, lower(text) AS low, CASE WHEN text IS NULL THEN 2 ELSE row_number() OVER (PARTITION BY text ORDER BY news_id) END AS nth FROM docs))"])
add("b20_chunk_text", lambda s, p: docs(s, p).select("news_id", F.posexplode(t.chunk_text(3000)("text")).alias("pos", "chunk")))
add("b21_target_keyword_count", lambda s, p: docs(s, p).select("news_id", t.target_keyword_count(F.col("text")).alias("n")), "SELECT news_id, CASE WHEN length(text) < 700 THEN 3 WHEN length(text) < 2300 THEN 4 WHEN length(text) < 4500 THEN 5 ELSE 6 END AS n FROM docs")
add("b22_verify_keywords", lambda s, p: docs(s, p).select("news_id", t.verify_keywords(F.array(F.lit("the er"), F.lit("nicht"), F.lit("zzz"), F.lit("de la"), F.lit("on")), F.col("text"), t.target_keyword_count(F.col("text"))).alias("keywords")),
    "SELECT news_id, list_filter(['de la', 'nicht', 'on', 'the er', 'zzz'], lambda k: contains(regexp_replace(text, '\\s+', '', 'g'), replace(k, ' ', '')))[1:CASE WHEN length(text) < 700 THEN 3 WHEN length(text) < 2300 THEN 4 WHEN length(text) < 4500 THEN 5 ELSE 6 END] AS keywords FROM docs")
add("b23_stock_name_map", names, "SELECT * FROM names", [NAMES])
add("b25_validate_stock_names", lambda s, p: funnel.validate_stock_names(_said_names(s, p), names(s, p)), "SELECT news_id, stock_id, min(pos)::INT AS pos FROM (SELECT p_partkey AS news_id, unnest([lower(p_name), 'nobody', 'red widget']) AS name, unnest([0, 1, 2]) AS pos FROM part) JOIN names USING (name) GROUP BY ALL", [NAMES])
add("b26_parse_enrichment", lambda s, p: _parsed(s, p).select("news_id", "attempt", "summary", "sentiment"), "SELECT news_id, attempt, CASE WHEN had THEN summary ELSE '' END AS summary, CASE WHEN had THEN sentiment ELSE '' END AS sentiment FROM said", [ANSWERS_SQL])
add("b27_enrichment_outcome", lambda s, p: funnel.enrichment_outcome(_parsed(s, p), docs(s, p).select("news_id", "text")),
    "SELECT d.news_id, CASE WHEN v.summary IS NOT NULL THEN v.summary ELSE substr(trim(d.text, ' '), 1, 220) END AS summary, coalesce(v.sentiment, '중립') AS sentiment, CASE WHEN v.summary IS NULL THEN CASE WHEN h.news_id IS NULL THEN 'failed_retryable' ELSE 'failed_permanent' END END AS status, CASE WHEN v.summary IS NULL THEN CASE WHEN h.news_id IS NULL THEN 'gemini_api_no_response' ELSE 'invalid_analysis_format' END END AS reason FROM docs d LEFT JOIN v USING (news_id) LEFT JOIN h USING (news_id)",
    [ANSWERS_SQL, "v AS (SELECT * FROM said WHERE had AND summary <> '' AND sentiment <> '' QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY attempt) = 1)", "h AS (SELECT DISTINCT news_id FROM said WHERE had)"])
add("b28_explode_enrichment", lambda s, p: funnel.explode_enrichment(_parsed(s, p), names(s, p))[1], "SELECT DISTINCT news_id, unnest(keywords) AS keyword FROM said WHERE had", [ANSWERS_SQL])
add("b29_count_term_matches", lambda s, p: docs(s, p).select("news_id", t.count_term_matches(F.col("text"), TERMS).alias("n")), "SELECT news_id, " + " + ".join(f"contains(lower(text), '{x}')::INT" for x in TERMS) + " AS n FROM docs")
add("b30_post_filter", _post,
    "SELECT news_id FROM docs WHERE news_id IN (SELECT news_id FROM news_stock) OR (" + " + ".join(f"contains(lower(text), '{x}')::INT" for x in TERMS) + ") >= 3 AND (" + " + ".join(f"contains(lower(text), '{x}')::INT" for x in UNWANTED) + ") <= 0")
add("b31_embedding_input", lambda s, p: docs(s, p).select("news_id", F.md5(t.embedding_input(F.col("text"))).alias("input_md5")), "SELECT news_id, CASE WHEN length(text) >= 10 THEN md5(substr(text, 1, 3000)) END AS input_md5 FROM docs")
add("b32_registry_update", lambda s, p: funnel.registry_update(a.news_keyword(s, p).select("keyword", F.lit("new").alias("vector")), a.read(s, p, "part").filter("p_size > 48").select(F.col("p_brand").alias("keyword")).distinct().withColumn("vector", F.lit("old"))),
    "SELECT keyword, CASE WHEN keyword IN (SELECT p_brand FROM part WHERE p_size > 48) THEN 'old' ELSE 'new' END AS vector FROM (SELECT p_brand AS keyword FROM part WHERE p_size > 48 UNION SELECT keyword FROM news_keyword)")
add("b33_parse_vector", lambda s, p: a.read(s, p, "embeddings", "vec_id", "label").select("vec_id", t.parse_vector(F.when(F.col("label") == 0, F.lit("[]")).when(F.col("label") != 1, F.concat(F.lit("[0.5, ,"), F.col("label").cast("string"), F.lit("]")))).alias("vector")), "SELECT vec_id, CASE WHEN label <= 1 THEN [] ELSE [0.5, label::DOUBLE] END AS vector FROM embeddings")
add("b34_times", lambda s, p: batch(s, p).select("news_id", t.to_kst(F.col("created_at")).cast("timestamp_ntz").alias("kst"), t.window_label(F.col("created_at"), F.col("created_at")).alias("label")), "SELECT news_id, created_at + INTERVAL 9 HOUR AS kst, strftime(created_at, '%Y%m%d%H%M') || '_' || strftime(created_at, '%Y%m%d%H%M') AS label FROM batch")
add("b35_context_hash", lambda s, p: a.read(s, p, "events", "event_id", "props").select("event_id", t.context_hash(F.col("props")).alias("hash")), "SELECT event_id, substr(sha256(props), 1, 16) AS hash FROM events")
add("b36_labels", lambda s, p: docs(s, p).select("news_id", t.clean_label(F.col("text")).alias("label"), t.cursor_reason(F.col("text")).alias("reason")),
    "SELECT news_id, CASE WHEN l = '' THEN 'none' ELSE l END AS label, " + "CASE " + " ".join(f"WHEN contains(lower(x), '{k}') THEN '{v}'" for k, v in t.CURSOR_REASONS) + " ELSE 'invalid_cursor' END AS reason FROM (SELECT news_id, text AS x, trim(regexp_replace(substr(text, 1, 64), '[^a-zA-Z0-9_.:-]+', '_', 'g'), '_') AS l FROM docs)")
add("c01_target_news", lambda s, p: funnel.target_news(batch(s, p)).select("news_id", "filter_status"), "SELECT news_id, filter_status FROM batch WHERE filter_status <> 'passed'")
add("c02_status_counts", lambda s, p: funnel.status_counts(batch(s, p).withColumn("day", F.date_format(t.to_kst(F.col("created_at")), "yyyyMMdd")), "day"), "SELECT strftime(created_at + INTERVAL 9 HOUR, '%Y%m%d') AS day, filter_status, count(*) AS count FROM batch GROUP BY ALL")

QUERIES, ORACLES = q, o
