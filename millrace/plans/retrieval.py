"""Queries for 2.E and 2.F."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import behaviour as d
from millrace.operators import retrieval as r
from millrace.operators import scores as sc
from millrace.operators import sessions as se
from millrace.operators.pools import FETCHED, free_lists, numbered
from millrace.plans import behaviour as bq
from millrace.plans.behaviour import SQL_D
from millrace.plans.keep import kept
from millrace.sources import adapters as a
from millrace.sources.adapters import END, START

AS_OF, POOL = "1998-07-01 00:00:00", 25
SQL_R = SQL_D + f""",
users AS (SELECT DISTINCT user_id FROM interactions),
acted AS (SELECT DISTINCT user_id, news_id FROM interactions),
pool AS (FROM articles ORDER BY pub_date DESC, news_id DESC LIMIT {4 * POOL}),
cand AS (SELECT user_id, news_id, pub_date, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, news_id DESC) AS rank FROM users, pool WHERE NOT EXISTS (SELECT 1 FROM acted x WHERE x.user_id = users.user_id AND x.news_id = pool.news_id) QUALIFY rank <= {POOL}),
ent AS (SELECT news_id, 'keyword' AS type, keyword AS id FROM news_keyword UNION SELECT news_id, 'stock', stock_id::VARCHAR FROM news_stock),
vec AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'stock' ELSE 'keyword' END AS type, CASE WHEN vec_id % 2 = 0 THEN (vec_id // 2)::VARCHAR ELSE 'Brand#' || (vec_id // 2) END AS id, embedding::DOUBLE[] AS vector FROM embeddings),
bq AS (SELECT user_id, type, id, count(*) AS frequency, ln(1 + count(*)) + 0.7 * sum(decay) + 0.3 * max(decay) AS weight FROM (
  SELECT user_id, 'keyword' AS type, unnest(keyword_ids) AS id, exp(-ln(2) * greatest((epoch_us(TIMESTAMP '{END}') - epoch_us(action_ts)) / 3.6e9, 0) / 24) AS decay FROM actions
  UNION ALL SELECT user_id, 'stock', unnest(stock_ids)::VARCHAR, exp(-ln(2) * greatest((epoch_us(TIMESTAMP '{END}') - epoch_us(action_ts)) / 3.6e9, 0) / 24) FROM actions)
  WHERE user_id IN (SELECT user_id FROM actions GROUP BY 1 HAVING count(*) >= 2) GROUP BY ALL),
bq2 AS (SELECT * FROM bq WHERE user_id IN (SELECT user_id FROM bq GROUP BY 1 HAVING count(*) >= 2)),
params AS (SELECT u.user_id, arms.arm AS path, 1 + 0.05 * coalesce(g.alpha, 0) + coalesce(s.alpha, 0) AS alpha, 199 + 0.05 * coalesce(g.beta, 0) + coalesce(s.beta, 0) AS beta FROM users u CROSS JOIN arms LEFT JOIN state g ON g.scope = 'global' AND g.path = arms.arm LEFT JOIN state s ON s.scope = 'user' AND s.user_id = u.user_id AND s.path = arms.arm),
lists AS (SELECT user_id, news_id, arm AS path, row_number() OVER (PARTITION BY user_id, arm ORDER BY last_at DESC, news_id) - 1 AS pos FROM (SELECT user_id, news_id, path, max(created_at) AS last_at FROM items GROUP BY ALL) JOIN arms USING (path)),
fixed AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY turn, arm, within) - 1 AS pos, news_id, path FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, news_id ORDER BY turn, arm, within) AS rn FROM (
    SELECT *, pos // w AS turn, pos % w AS within FROM (SELECT l.*, list_position(['onboarding', 'behavior', 'breaking', 'popular'], path) AS arm, [2, 2, 1, 1][list_position(['onboarding', 'behavior', 'breaking', 'popular'], path)] AS w FROM lists l))) WHERE rn = 1)
"""


def users(s, p):
    return a.interactions(s, p).select("user_id").distinct()


def acted(s, p):
    return a.interactions(s, p).select("user_id", "news_id").distinct()


def candidates(s, p):
    return r.recent_candidates(a.articles(s, p), users(s, p), acted(s, p), AS_OF, POOL)


def entities(s, p):
    return r.news_entities(a.news_keyword(s, p), a.news_stock(s, p))


def vectors(s, p):
    half = F.floor(F.col("vec_id") / 2).cast("string")
    return a.read(s, p, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "Stock").otherwise("keyword").alias("type"), F.when(F.col("vec_id") % 2 == 0, half).otherwise(F.concat(F.lit("Brand#"), half)).alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def actions(s, p):
    return d.recent_actions(bq.snapshot(s, p, kept), 20)


def behavior_query(s, p):
    return r.behavior_query(actions(s, p), END)


def profile(s, p):
    c = a.read(s, p, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_custkey", "user_id")
    return r.onboarding_profile(c.filter("c_acctbal > 0").select("user_id", F.col("c_nationkey").alias("stock_id")), c.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("user_id", F.concat(F.lit("Brand#"), F.col("c_nationkey")).alias("keyword_id")))


def _max_sims(s, p):
    """E14 of E2's candidates: scores of the whole pool by place, read for each user's part of it."""
    pool = kept(numbered(a.articles(s, p).select("news_id", "pub_date"), F.desc("pub_date"), F.desc("news_id"), limit=FETCHED * POOL)).select("news_id", "place")
    held = kept(sc.pool_entities(pool, entities(s, p), vectors(s, p)))
    scores = sc.pool_scores(kept(behavior_query(s, p)), held, FETCHED * POOL, vectors(s, p), 0.2, kept)
    each = free_lists(pool, users(s, p), acted(s, p), POOL, scores)
    return each.select("user_id", "news_id", F.round(F.coalesce(F.get("scores", "place"), F.lit(0.0)), 5).alias("score"))


LIMITS = se.Limits()


def seen_articles(s, p):
    """News up to the moment that counts as now."""
    return a.articles(s, p).filter(F.col("pub_date") <= F.lit(AS_OF).cast("timestamp_ntz"))


def _snapshots(s, p, limit=2500):
    return r.popular_from_snapshots(d.popular_top(bq._scored(s, p), END), a.read(s, p, "orders").select(F.col("o_orderkey").alias("news_id")), END, limit)


def _fallback(s, p, limit):
    return r.popular_fallback(seen_articles(s, p), bq.metrics(s, p), AS_OF, limit, LIMITS.base_hours, END)


def _pools(s, p, excluded):
    """The pools; the fallback reaches as deep as the most exclusions of a user among recent news make it."""
    recent = seen_articles(s, p).filter(F.col("pub_date") >= F.lit(AS_OF).cast("timestamp_ntz") - F.make_interval(hours=F.lit(LIMITS.base_hours)))
    most = excluded.join(recent.select("news_id"), "news_id").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return se.pools(seen_articles(s, p), _snapshots(s, p), _fallback(s, p, 2 * FETCHED * LIMITS.popular + most), AS_OF, LIMITS, kept)


def _signals(s, p):
    own, recent = kept(profile(s, p).join(users(s, p), "user_id", "left_semi")), kept(actions(s, p))
    return se.Signals(own.select("user_id"), kept(r.onboarding_query(own)), kept(r.behavior_query(recent, END)), recent.select("user_id", "news_id"))


def _failures(s, p):
    """Lookups that failed, as customers' columns have it."""
    c = a.read(s, p, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    segment = {"onboarding_failed": "FURNITURE", "behavior_failed": "HOUSEHOLD", "breaking_failed": "AUTOMOBILE"}
    flags = [((F.col("c_mktsegment") == v) & (F.col("c_acctbal") > 7000)).alias(k) for k, v in segment.items()]
    return c.select(F.col("c_custkey").alias("user_id"), *flags, (F.col("c_acctbal") < 0).alias("lookup_failed"), (F.col("c_acctbal") > 9500).alias("base_failed"))


def _rows(s, p, limits=LIMITS):
    """Every user's four lists, before penalties, with acted news excluded and nothing failed."""
    excluded = kept(acted(s, p))
    found = _pools(s, p, excluded)
    based = kept(se.with_failures(se.bases(users(s, p), excluded, found), None))
    return se.retrieved(se.scored_paths(based, found, _signals(s, p), entities(s, p), vectors(s, p), limits, kept), found, limits)


def _scored_list(path):
    def query(s, p):
        each = _rows(s, p).select("user_id", F.explode(path).alias("x"))
        return each.select("user_id", "x.news_id", F.round("x.score", 4).alias("score"))

    return query


def lists(s, p):
    items = d.explode_served_items(a.serves(s, p), START, END).join(a.serves(s, p).select("request_id", "created_at"), "request_id")
    arm = F.create_map(*[F.lit(x) for pair in d.ARMS.items() for x in pair])[F.col("path")]
    last = items.groupBy("user_id", "news_id", arm.alias("path")).agg(F.max("created_at").alias("last_at"))
    return last.withColumn("pos", F.row_number().over(W.partitionBy("user_id", "path").orderBy(F.desc("last_at"), "news_id")) - 1).drop("last_at")


def params(s, p):
    return r.arm_params(d.bandit_lookup(bq.state(s, p), users(s, p), list(d.ARMS.values())))


def fixed(s, p):
    return r.fixed_mix(lists(s, p), {"onboarding": 2, "behavior": 2, "breaking": 1, "popular": 1})


def _popular(s, p):
    return _snapshots(s, p, 50)


def _requests(s, p):
    return a.serves(s, p).select("user_id", "request_id", F.col("created_at").alias("ts"), F.when(F.col("id") % 11 == 0, "forced").alias("override"))


def _penalised(s, p):
    _, multipliers = r.suppression(acted(s, p), d.read_news(a.interactions(s, p), END, 31), d.recent_serves(a.serves(s, p), END, bq.HOURS), END)
    shown = lists(s, p).filter("path = 'popular'").select("user_id", "news_id", F.lit(None).cast("double").alias("score"), (F.col("pos") + 1).alias("rank"))
    return r.apply_exposure_penalty(shown, multipliers).withColumn("key", F.round("key", 6)).drop("score")


def _most_acted(s, p):
    """The two news that most users acted on, as a pool."""
    counts = acted(s, p).join(a.articles(s, p).select("news_id"), "news_id").groupBy("news_id").agg(F.count("*").alias("n"))
    return numbered(counts, F.desc("n"), F.col("news_id"), limit=2).select("news_id", "place")


def _sessions(s, p):
    """The first request of each user, showing 20 news from the eleventh on."""
    return a.serves(s, p).groupBy("user_id").agg(F.min("request_id").alias("request_id")).select(
        "user_id", "request_id", F.lit(10).alias("offset"), F.lit(20).alias("limit"), F.lit(1).alias("batch_generation_id"), F.lit("exp").alias("experiment_id"), F.lit("recommend").alias("variant")
    )


def _sessions_of_all(s, p, failures=None):
    excluded, multipliers = r.suppression(acted(s, p), d.read_news(a.interactions(s, p), END, 31), d.recent_serves(a.serves(s, p), END, bq.HOURS), END)
    excluded = kept(excluded)
    last = r.assign_variant(_requests(s, p), r.variant_slots("recommend:3,latest:1,popular:1,random:1")).groupBy("user_id").agg(F.max_by("variant", F.struct("ts", "request_id")).alias("variant"))
    signals = _signals(s, p)
    recent = signals.actions.groupBy("user_id").agg(F.count("*").alias("n"))
    of = users(s, p).join(last, "user_id", "left").join(recent, "user_id", "left")
    of = kept(of.select("user_id", F.coalesce("variant", F.lit("recommend")).alias("variant"), r.user_state(F.coalesce("n", F.lit(0)), F.lit("db")).alias("state")))
    return se.sessions(of, excluded, kept(multipliers), signals, entities(s, p), vectors(s, p), _pools(s, p, excluded), kept, kept(params(s, p)), failures, LIMITS, "mean")


def recommend_all(s, p):
    """exclusions, the paths' candidates, penalties, arms, mix and variants of all users, as pages with what fell back."""
    told, timelines = _sessions_of_all(s, p)
    return r.page_slice(timelines, LIMITS.page).join(told, "user_id")


q, o = {}, {}


def add(name, query, sql=None):
    q[name] = query
    if sql:
        o[name] = SQL_R + " " + sql


add("e01_onboarding_profile", profile, "SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 0 THEN [c_nationkey::VARCHAR] ELSE [] END AS stock_ids, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ['Brand#' || c_nationkey] ELSE [] END AS keyword_ids FROM customer WHERE c_acctbal > 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')")
add("e02_recent_candidates", candidates, "SELECT * FROM cand")
add("e04_popular_from_snapshots", _popular, f"SELECT news_id, (row_number() OVER (ORDER BY score DESC, click_count DESC, impression_count DESC, news_id DESC) - 1)::INT AS rank, TIMESTAMP '{END}' AS snapshot_at FROM scored WHERE news_id IN (SELECT news_id FROM articles) ORDER BY score DESC, click_count DESC, impression_count DESC, news_id DESC LIMIT 50")
# Reference semantics of E5: rates of the last 7 days, news of the last 72 hours.
FALLBACK_SQL = f"""fb AS (SELECT news_id, coalesce(c, 0) AS ctr, pub_date FROM articles
  LEFT JOIN (SELECT news_id, sum(click_count) / nullif(sum(impression_count), 0) AS c FROM pm WHERE bucket_start >= TIMESTAMP '{END}' - INTERVAL 7 DAY GROUP BY 1) USING (news_id)
  WHERE pub_date BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AND TIMESTAMP '{AS_OF}')"""
SNAPSHOT_SQL = """snaps AS (SELECT news_id, row_number() OVER (ORDER BY score DESC, click_count DESC, impression_count DESC, news_id DESC) - 1 AS rank
  FROM scored WHERE news_id IN (SELECT news_id FROM articles))"""
# All news and all metrics: these are one bucket of a month, so no window of days that begins inside it has any.
add("e05_popular_fallback", lambda s, p: r.popular_fallback(seen_articles(s, p), bq.metrics(s, p), AS_OF, 300, None, days=None).withColumn("ctr", F.round("ctr", 6)),
    f" SELECT news_id, round(coalesce(c, 0), 6) AS ctr, pub_date FROM articles LEFT JOIN (SELECT news_id, sum(click_count) / nullif(sum(impression_count), 0) AS c FROM pm GROUP BY 1) USING (news_id) WHERE pub_date <= TIMESTAMP '{AS_OF}' ORDER BY coalesce(c, 0) DESC, pub_date DESC, news_id DESC LIMIT 300")
# Of the newest 4 * 20 behind the offset, the first 20 that the user may see.
add("e03_latest_ids", lambda s, p: r.latest_ids(a.articles(s, p), users(s, p), acted(s, p), 20, 5),
    """, fetched AS (FROM articles ORDER BY pub_date DESC, news_id DESC LIMIT 80 OFFSET 5)
    SELECT user_id, news_id, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, news_id DESC) - 1 AS pos FROM users, fetched
    WHERE NOT EXISTS (SELECT 1 FROM acted x WHERE x.user_id = users.user_id AND x.news_id = fetched.news_id) QUALIFY pos < 20""")
add("e06_popular_candidates", lambda s, p: r.popular_candidates(_popular(s, p), _fallback(s, p, 600), 150),
    f""", {SNAPSHOT_SQL}, {FALLBACK_SQL}, top AS (SELECT news_id, 0 AS part, row_number() OVER (ORDER BY rank) - 1 AS nth FROM snaps WHERE rank < 50),
    more AS (SELECT news_id, 1, 50 + row_number() OVER (ORDER BY ctr DESC, pub_date DESC, news_id DESC) - 1 FROM fb WHERE news_id NOT IN (SELECT news_id FROM top) AND (SELECT count(*) FROM top) < 75)
    SELECT news_id, part, (row_number() OVER (ORDER BY part, nth) - 1)::INT AS place FROM (FROM top UNION ALL FROM more) QUALIFY place < 150""")
add("e07_news_entities", entities, "SELECT * FROM ent")
add("e08_entity_vectors", lambda s, p: r.entity_vectors(entities(s, p), vectors(s, p)).select("type", "id", "news_id"), "SELECT type, id, news_id FROM ent JOIN vec USING (type, id)")
add("e09_onboarding_query", lambda s, p: r.onboarding_query(profile(s, p)), "SELECT c_custkey AS user_id, 'stock' AS type, c_nationkey::VARCHAR AS id, 1.0::DOUBLE AS weight FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'keyword', 'Brand#' || c_nationkey, 1.0 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
add("e10_behavior_query", lambda s, p: behavior_query(s, p).withColumn("weight", F.round("weight", 6)), "SELECT user_id, type, id, frequency, round(weight, 6) AS weight FROM bq2")
add("e11_time_decay", lambda s, p: a.read(s, p, "events", "event_id", "ts").select("event_id", F.round(r.time_decay(F.col("ts"), F.lit(END).cast("timestamp_ntz"), 24), 6).alias("decay")), f"SELECT event_id, round(exp(-ln(2) * (epoch_us(TIMESTAMP '{END}') - epoch_us(ts)) / 3.6e9 / 24), 6) AS decay FROM events")
add("e12_cosine", lambda s, p: (lambda v: v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(r.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine")))(a.read(s, p, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))),
    "SELECT x.vec_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
add("e14_max_sim", _max_sims,
    """, sim AS (SELECT q.type AS q_type, q.id AS q_id, c.type, c.id, list_cosine_similarity(q.vector, c.vector) * CASE WHEN q.type <> c.type THEN 0.9 WHEN q.type = 'stock' THEN 1.15 ELSE 1.0 END AS sim FROM vec q, vec c),
    best AS (SELECT c.user_id, c.news_id, b.type, b.id, any_value(b.weight) AS weight, max(sim) AS sim FROM cand c JOIN ent e USING (news_id) JOIN sim s ON s.type = e.type AND s.id = e.id JOIN bq2 b ON b.user_id = c.user_id AND b.type = s.q_type AND b.id = s.q_id WHERE sim > 0 GROUP BY ALL),
    hits AS (SELECT c.user_id, c.news_id, count(DISTINCT e.id) AS hits FROM cand c JOIN ent e USING (news_id) JOIN vec USING (type, id) JOIN bq2 b ON b.user_id = c.user_id AND b.type = 'stock' AND e.type = 'stock' AND b.id = e.id AND b.frequency > 1 GROUP BY ALL)
    SELECT user_id, news_id, round(coalesce(sc, 0) + 0.2 * coalesce(hits, 0), 5) AS score FROM cand LEFT JOIN (SELECT user_id, news_id, sum(weight * sim) AS sc FROM best GROUP BY ALL) USING (user_id, news_id) LEFT JOIN hits USING (user_id, news_id)""")
add("e15_rank_candidates", lambda s, p: r.rank_candidates(candidates(s, p).withColumn("score", F.round(F.col("news_id") % 7 + 0.0, 1)).drop("rank"), 5).select("user_id", "news_id", "rank"),
    " SELECT user_id, news_id, nth AS rank FROM (SELECT user_id, news_id, row_number() OVER (PARTITION BY user_id ORDER BY news_id % 7 DESC, pub_date DESC, news_id DESC) AS nth FROM cand) WHERE nth <= 5")
# The cascade of a user without failures: base pool of 200 from the newest 800 of 72 hours, each path from what those before it left.
CASCADE_SQL = f""", {SNAPSHOT_SQL}, {FALLBACK_SQL}, lately AS (SELECT * FROM articles WHERE pub_date BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AND TIMESTAMP '{AS_OF}'),
newest AS (FROM lately ORDER BY pub_date DESC, news_id DESC LIMIT 800),
base AS (SELECT user_id, news_id, pub_date, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, news_id DESC) AS nth
  FROM users, newest WHERE NOT EXISTS (SELECT 1 FROM acted x WHERE x.user_id = users.user_id AND x.news_id = newest.news_id) QUALIFY nth <= 200),
sim AS (SELECT q.type AS q_type, q.id AS q_id, c.type, c.id, list_cosine_similarity(q.vector, c.vector) * CASE WHEN q.type <> c.type THEN 0.9 WHEN q.type = 'stock' THEN 1.15 ELSE 1.0 END AS sim FROM vec q, vec c),
held AS (SELECT news_id, type, id FROM ent JOIN vec USING (type, id) WHERE news_id IN (SELECT news_id FROM newest)),
asked AS (SELECT c_custkey AS user_id, 'stock' AS type, c_nationkey::VARCHAR AS id, 1.0::DOUBLE AS weight, 'onboarding' AS path, true AS boosted FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT c_custkey, 'keyword', 'Brand#' || c_nationkey, 1.0, 'onboarding', false FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT user_id, type, id, weight, 'behavior', type = 'stock' AND frequency > 1 FROM bq2),
best AS (SELECT a.path, b.user_id, b.news_id, a.type, a.id, any_value(a.weight) AS weight, max(s.sim) AS sim
  FROM base b JOIN held h USING (news_id) JOIN asked a ON a.user_id = b.user_id JOIN sim s ON s.q_type = a.type AND s.q_id = a.id AND s.type = h.type AND s.id = h.id WHERE s.sim > 0 GROUP BY ALL),
hits AS (SELECT a.path, b.user_id, b.news_id, count(DISTINCT h.id) AS hits FROM base b JOIN held h USING (news_id) JOIN asked a ON a.user_id = b.user_id AND a.boosted AND h.type = 'stock' AND h.id = a.id GROUP BY ALL),
rated AS (SELECT p.path, b.*, coalesce(s.score, 0) + CASE p.path WHEN 'onboarding' THEN 0.35 ELSE 0.2 END * coalesce(hits, 0) AS score
  FROM base b JOIN (SELECT DISTINCT path, user_id FROM asked) p USING (user_id)
  LEFT JOIN (SELECT path, user_id, news_id, sum(weight * sim) AS score FROM best GROUP BY ALL) s ON s.path = p.path AND s.user_id = b.user_id AND s.news_id = b.news_id
  LEFT JOIN hits h ON h.path = p.path AND h.user_id = b.user_id AND h.news_id = b.news_id),
onb AS (SELECT user_id, news_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pub_date DESC, news_id DESC) AS nth FROM rated WHERE path = 'onboarding' QUALIFY nth <= 50),
left1 AS (SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM onb o WHERE o.user_id = b.user_id AND o.news_id = b.news_id)
  AND NOT EXISTS (SELECT 1 FROM actions x WHERE x.user_id = b.user_id AND x.news_id = b.news_id)),
beh AS (SELECT user_id, news_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pub_date DESC, news_id DESC) AS nth FROM rated r
    WHERE path = 'behavior' AND EXISTS (SELECT 1 FROM left1 l WHERE l.user_id = r.user_id AND l.news_id = r.news_id) QUALIFY nth <= 50 AND score >= 0.05
  UNION ALL SELECT user_id, news_id, NULL, row_number() OVER (PARTITION BY user_id ORDER BY nth) AS n FROM left1
    WHERE user_id IN (SELECT user_id FROM actions) AND user_id NOT IN (SELECT user_id FROM bq2) QUALIFY n <= 50),
taken2 AS (SELECT user_id, news_id FROM acted UNION SELECT user_id, news_id FROM onb UNION SELECT user_id, news_id FROM beh),
fresh AS (FROM lately WHERE pub_date >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR ORDER BY pub_date DESC, news_id DESC LIMIT 120),
brk AS (SELECT user_id, news_id, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, news_id DESC) AS nth FROM users, fresh f
  WHERE NOT EXISTS (SELECT 1 FROM taken2 t WHERE t.user_id = users.user_id AND t.news_id = f.news_id) QUALIFY nth <= 30),
taken3 AS (FROM taken2 UNION SELECT user_id, news_id FROM brk),
shown AS (SELECT user_id, news_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS nth FROM users, snaps
  WHERE NOT EXISTS (SELECT 1 FROM taken3 t WHERE t.user_id = users.user_id AND t.news_id = snaps.news_id) QUALIFY nth <= 120),
pop AS (SELECT user_id, news_id, nth FROM shown UNION ALL
  SELECT user_id, news_id, 120 + row_number() OVER (PARTITION BY user_id ORDER BY ctr DESC, pub_date DESC, news_id DESC) FROM users, fb
  WHERE user_id NOT IN (SELECT user_id FROM shown GROUP BY 1 HAVING count(*) >= 15) AND NOT EXISTS (SELECT 1 FROM taken3 t WHERE t.user_id = users.user_id AND t.news_id = fb.news_id)
  AND NOT EXISTS (SELECT 1 FROM shown t WHERE t.user_id = users.user_id AND t.news_id = fb.news_id)),
casc AS (SELECT user_id, news_id, 'onboarding' AS path, nth FROM onb UNION ALL SELECT user_id, news_id, 'behavior', nth FROM beh UNION ALL SELECT user_id, news_id, 'breaking', nth FROM brk
  UNION ALL SELECT user_id, news_id, 'popular', nth FROM pop)
"""
add("e16_onboarding_path", _scored_list("onboarding"), CASCADE_SQL + "SELECT user_id, news_id, round(score, 4) AS score FROM onb")
add("e17_behavior_path", _scored_list("behavior"), CASCADE_SQL + "SELECT user_id, news_id, round(score, 4) AS score FROM beh")
add("e18_path_cascade", lambda s, p: se.path_rows(_rows(s, p)), CASCADE_SQL + "SELECT user_id, news_id, path, row_number() OVER (PARTITION BY user_id, path ORDER BY nth) - 1 AS pos FROM casc QUALIFY path <> 'popular' OR pos < 30")
add("e19_breaking_replenish", lambda s, p: se.path_rows(_rows(s, p, LIMITS._replace(replenish=8))))
add("e20_fallback_reason", lambda s, p: _sessions_of_all(s, p, _failures(s, p))[0])
add("e21_suppression", lambda s, p: r.suppression(acted(s, p), d.read_news(a.interactions(s, p), END, 31), d.recent_serves(a.serves(s, p), END, bq.HOURS), END, 86400)[0], f"SELECT user_id, news_id FROM acted UNION SELECT user_id, news_id FROM (SELECT user_id, news_id, max(created_at) AS m FROM items GROUP BY ALL) WHERE m >= TIMESTAMP '{END}' - INTERVAL 1 DAY")
add("e22_exposure_penalty", _penalised,
    ", pen AS (SELECT l.user_id, l.news_id, l.pos + 1 AS rank, (count(*) OVER (PARTITION BY l.user_id) - l.pos) * greatest(0.2, 1 - 0.25 * c.n) AS key FROM lists l JOIN (SELECT user_id, news_id, count(*) AS n FROM items GROUP BY ALL) c USING (user_id, news_id) WHERE path = 'popular') SELECT user_id, news_id, rank, round(key, 6) AS key, row_number() OVER (PARTITION BY user_id ORDER BY key DESC, rank) AS new_rank FROM pen")
add("e23_user_state", lambda s, p: d.request_count(a.serves(s, p)).select("user_id", r.user_state(F.col("requests") % 4, F.when(F.col("user_id") % 3 == 0, "x_warm").when(F.col("user_id") % 3 == 1, "x_cold").otherwise("x")).alias("state")),
    "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'warm' WHEN user_id % 3 = 1 THEN 'cold' WHEN n % 4 >= 2 THEN 'warm' ELSE 'cold' END AS state FROM (SELECT user_id, count(DISTINCT request_id) AS n FROM served GROUP BY 1)")
add("e24_public_path", lambda s, p: lists(s, p).select("user_id", "news_id", t.public_path(F.col("path")).alias("code"), t.public_path(F.concat(F.lit("x"), "path")).alias("other")), "SELECT user_id, news_id, a.path AS code, 'X' || upper(l.path) AS other FROM lists l JOIN arms a ON a.arm = l.path")
add("e25_top_k_similar", lambda s, p: (lambda v: r.top_k_similar(v, v, 10).withColumn("similarity", F.round("similarity", 6)))(a.read(s, p, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))),
    ", sim AS (SELECT x.vec_id AS query, y.vec_id AS id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank, round(c, 6) AS similarity FROM sim QUALIFY rank <= 10")
add("e26_context_override", lambda s, p: r.context_override(d.request_count(a.serves(s, p)).withColumn("source", F.lit("db")), users(s, p).filter("user_id % 4 = 0").withColumn("requests", F.when(F.col("user_id") % 8 == 0, F.lit(-1)).cast("long")), "requests"),
    "SELECT user_id, CASE WHEN user_id % 4 = 0 AND user_id IN (SELECT user_id FROM users) THEN CASE WHEN user_id % 8 = 0 THEN -1 END ELSE n END AS requests, CASE WHEN user_id % 4 = 0 AND user_id IN (SELECT user_id FROM users) THEN 'debug_override' ELSE 'db' END AS source FROM (SELECT user_id, count(DISTINCT request_id) AS n FROM served GROUP BY 1)")
add("f01_fixed_mix", fixed, "SELECT * FROM fixed")
add("f02_breaking_guardrail", lambda s, p: r.breaking_guardrail(fixed(s, p), 10, 3),
    """, win AS (SELECT *, count(*) FILTER (path = 'breaking' AND pos < 10) OVER (PARTITION BY user_id) AS have, row_number() OVER (PARTITION BY user_id, pos < 10, path = 'breaking' ORDER BY pos) AS late, row_number() OVER (PARTITION BY user_id, pos < 10, path = 'breaking' ORDER BY pos DESC) AS last FROM fixed),
    swaps AS (SELECT i.user_id, i.pos AS f, o.pos AS t FROM win i JOIN win o ON o.user_id = i.user_id AND o.last = i.late WHERE i.pos >= 10 AND i.path = 'breaking' AND i.late <= 3 - i.have AND o.pos < 10 AND o.path <> 'breaking' AND o.last <= 3 - o.have),
    moves AS (SELECT user_id, f AS pos, t AS np FROM swaps UNION ALL SELECT user_id, t, f FROM swaps) SELECT user_id, coalesce(np, pos) AS pos, news_id, path FROM fixed LEFT JOIN moves USING (user_id, pos)""")
add("f03_arm_params", lambda s, p: params(s, p).select("user_id", "path", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta")), "SELECT user_id, path, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM params")
add("f04_thompson_mix", lambda s, p: r.thompson_mix(lists(s, p), params(s, p), "mean"))
add("f05_arm_scores", lambda s, p: r.arm_scores(params(s, p)).withColumn("score", F.round("score", 6)), "SELECT user_id, path, round(alpha / (alpha + beta), 6) AS score FROM params")
add("f05_mix_counts", lambda s, p: r.mix_counts(fixed(s, p)), "SELECT user_id, path, count(*) AS items FROM fixed GROUP BY ALL")
add("f09_assign_variant", lambda s, p: r.assign_variant(_requests(s, p), r.variant_slots("recommend:3,latest:1,popular,bad:x")).select("user_id", "request_id", "eligible", "variant"),
    """, req AS (SELECT DISTINCT user_id, request_id, id, created_at AS ts FROM served), el AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) > 5 AND id % 11 <> 0 AS eligible FROM req)
    SELECT user_id, request_id, eligible, CASE WHEN id % 11 = 0 THEN 'forced' WHEN eligible THEN ['recommend', 'recommend', 'recommend', 'latest', 'popular'][1 + ((sum(eligible::INT) OVER (PARTITION BY user_id ORDER BY ts, request_id) - 1) % 5)::INT] ELSE 'recommend' END AS variant FROM el""")
add("f10_experiment_eligible", lambda s, p: r.assign_variant(_requests(s, p), []).select("user_id", "request_id", "eligible", "variant"),
    """, req AS (SELECT DISTINCT user_id, request_id, id, created_at AS ts FROM served)
    SELECT user_id, request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) > 5 AND id % 11 <> 0 AS eligible, CASE WHEN id % 11 = 0 THEN 'forced' ELSE 'recommend' END AS variant FROM req""")
add("f11_stable_bucket", lambda s, p: users(s, p).select("user_id", t.stable_bucket(F.lit("exp"), F.col("user_id"), 100).alias("bucket")), "SELECT user_id, (('0x' || substr(sha256('exp:' || user_id), 1, 16))::UBIGINT % 100)::INT AS bucket FROM users")
add("f12_random_timeline", lambda s, p: r.random_timeline(numbered(a.articles(s, p).select("news_id", "pub_date"), F.desc("pub_date"), F.desc("news_id"), limit=50), users(s, p), acted(s, p), 7, a.articles(s, p), 20, 30),
    """, p50 AS (FROM articles ORDER BY pub_date DESC, news_id DESC LIMIT 50), p80 AS (FROM articles ORDER BY pub_date DESC, news_id DESC LIMIT 80),
    own AS (SELECT user_id, news_id, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, news_id DESC) AS nth FROM users, p50
      WHERE NOT EXISTS (SELECT 1 FROM acted x WHERE x.user_id = users.user_id AND x.news_id = p50.news_id) QUALIFY nth <= 30)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ('0x' || substr(md5('7:' || user_id || ':' || news_id), 1, 15))::BIGINT, news_id) - 1 AS pos, news_id, 'random' AS path, NULL::VARCHAR AS fallback_reason FROM own
    UNION ALL SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, news_id DESC) - 1 AS pos, news_id, 'latest', 'random_pool_empty' FROM users, p80
      WHERE user_id NOT IN (SELECT user_id FROM own) AND NOT EXISTS (SELECT 1 FROM acted x WHERE x.user_id = users.user_id AND x.news_id = p80.news_id)) WHERE pos < 20""")
add("f04_thompson_sample", lambda s, p: r.thompson_mix(lists(s, p), params(s, p), "sample"))
add("f12_latest_timeline", lambda s, p: r.latest_timeline(a.articles(s, p), users(s, p), acted(s, p), 20),
    """ SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, news_id DESC) - 1 AS pos, news_id, 'latest' AS path, NULL::VARCHAR AS fallback_reason
    FROM users, (FROM articles ORDER BY pub_date DESC, news_id DESC LIMIT 80) f WHERE NOT EXISTS (SELECT 1 FROM acted x WHERE x.user_id = users.user_id AND x.news_id = f.news_id) QUALIFY pos < 20""")
add("f12_popular_timeline", lambda s, p: r.pool_timeline(_most_acted(s, p), users(s, p), acted(s, p), "popular", a.articles(s, p), 10),
    """, pop AS (SELECT news_id, row_number() OVER (ORDER BY count(*) DESC, news_id) - 1 AS place FROM acted JOIN articles USING (news_id) GROUP BY news_id QUALIFY place < 2),
    kept AS (SELECT user_id, news_id, row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS pos FROM users, pop WHERE NOT EXISTS (SELECT 1 FROM acted x WHERE x.user_id = users.user_id AND x.news_id = pop.news_id))
    SELECT user_id, pos, news_id, 'popular' AS path, NULL::VARCHAR AS fallback_reason FROM kept UNION ALL
    SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pub_date DESC, news_id DESC) - 1 AS pos, news_id, 'latest', 'popular_pool_empty' FROM users, (FROM articles ORDER BY pub_date DESC, news_id DESC LIMIT 40) f
    WHERE user_id NOT IN (SELECT user_id FROM kept) AND NOT EXISTS (SELECT 1 FROM acted x WHERE x.user_id = users.user_id AND x.news_id = f.news_id)) WHERE pos < 10""")
add("f17_impression_rows", lambda s, p: r.impression_rows(fixed(s, p), _sessions(s, p)),
    """, sess AS (SELECT user_id, min(request_id) AS request_id FROM served GROUP BY 1)
    SELECT request_id, request_id AS session_id, user_id, news_id, pos + 1 AS rank, path, 1 AS batch_generation_id, 'exp' AS experiment_id, 'recommend' AS variant FROM fixed JOIN sess USING (user_id) WHERE pos >= 10 AND pos < 30""")
add("f14_append_batch", lambda s, p: r.append_batch(fixed(s, p).filter("pos < 15"), fixed(s, p).filter("pos >= 12")), "SELECT user_id, pos, news_id, path FROM fixed")
add("f15_page_slice", lambda s, p: r.page_slice(fixed(s, p), 20), "SELECT user_id, pos, news_id, path, pos // 20 AS page, pos + 1 AS rank, CASE WHEN (pos // 20 + 1) * 20 < count(*) OVER (PARTITION BY user_id) THEN (pos // 20 + 1) * 20 END AS next_offset FROM fixed")
add("f18_queue_remaining", lambda s, p: r.queue_remaining(lists(s, p), fixed(s, p).filter("pos < 20")), "SELECT user_id, path, count(*) AS remaining FROM lists l WHERE NOT EXISTS (SELECT 1 FROM fixed f WHERE f.user_id = l.user_id AND f.news_id = l.news_id AND f.pos < 20) GROUP BY ALL")
add("f19_recommend_all", recommend_all)

QUERIES, ORACLES = q, o
