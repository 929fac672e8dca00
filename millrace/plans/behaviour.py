"""Queries for 2.D."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import behaviour as d
from millrace.sources import adapters as a
from millrace.sources.adapters import END, SQL, START

HOURS = 744
SQL_D = SQL + f""",
items AS (SELECT * FROM served WHERE created_at >= '{START}' AND created_at < '{END}'),
imp AS (SELECT request_id, user_id, news_id, path FROM items QUALIFY row_number() OVER (PARTITION BY request_id, news_id ORDER BY position, id, path) = 1),
opens AS (SELECT request_id, user_id, news_id, content_session_id, min(coalesce(event_ts_client, event_ts_server)) AS open_ts FROM interactions
  WHERE event_type = 'content_open' AND event_ts_server >= '{START}' AND event_ts_server < '{END}' GROUP BY ALL),
clicks AS (SELECT DISTINCT request_id, user_id, news_id, 1::BIGINT AS click_count FROM opens),
leaves AS (SELECT content_session_id, min(coalesce(event_ts_client, event_ts_server)) AS leave_ts FROM interactions
  WHERE event_type = 'content_leave' AND event_ts_server >= '{START}' AND event_ts_server < TIMESTAMP '{END}' + INTERVAL 1 HOUR GROUP BY ALL),
sessions AS (SELECT request_id, user_id, news_id, content_session_id, greatest(epoch_us(leave_ts) - epoch_us(open_ts), 0) / 1e6 AS dwell_seconds
  FROM opens JOIN leaves USING (content_session_id) WHERE leave_ts >= open_ts),
dwells AS (SELECT request_id, user_id, news_id, count(*) AS dwell_event_count, count(*) FILTER (dwell_seconds >= 5) AS dwell_5s_count,
  count(*) FILTER (dwell_seconds >= 30) AS dwell_30s_count, sum(ln(1 + dwell_seconds)) AS sum_log_dwell_time FROM sessions GROUP BY ALL),
pm AS (SELECT TIMESTAMP '{START}' AS bucket_start, TIMESTAMP '{END}' AS bucket_end, news_id, path, count(*) AS impression_count,
  coalesce(sum(click_count), 0)::BIGINT AS click_count, coalesce(sum(dwell_5s_count), 0)::BIGINT AS dwell_5s_count, coalesce(sum(dwell_30s_count), 0)::BIGINT AS dwell_30s_count,
  coalesce(sum(dwell_event_count), 0)::BIGINT AS dwell_event_count, coalesce(sum(sum_log_dwell_time), 0) AS sum_log_dwell_time
  FROM imp LEFT JOIN clicks USING (request_id, user_id, news_id) LEFT JOIN dwells USING (request_id, user_id, news_id) GROUP BY news_id, path),
tot AS (SELECT * FROM pm UNION ALL BY NAME SELECT bucket_start, bucket_end, news_id, 'TOTAL' AS path, sum(impression_count)::BIGINT AS impression_count, sum(click_count)::BIGINT AS click_count,
  sum(dwell_5s_count)::BIGINT AS dwell_5s_count, sum(dwell_30s_count)::BIGINT AS dwell_30s_count, sum(dwell_event_count)::BIGINT AS dwell_event_count, sum(sum_log_dwell_time) AS sum_log_dwell_time FROM pm GROUP BY ALL),
ctr AS (SELECT news_id, sum(impression_count)::BIGINT AS impression_count, sum(click_count)::BIGINT AS click_count FROM tot WHERE path IN ('A1', 'A2', 'B') GROUP BY news_id),
prior AS (SELECT coalesce(sum(click_count) / nullif(sum(impression_count), 0), 0) AS prior_ctr FROM ctr),
scored AS (SELECT news_id, impression_count, click_count, (click_count + prior_ctr * 20.0) / (impression_count + 20.0) AS score FROM ctr, prior),
uopens AS (SELECT user_id, news_id, content_session_id, min(coalesce(event_ts_client, event_ts_server)) AS view_ts FROM interactions WHERE event_type = 'content_open' GROUP BY ALL),
activity AS (SELECT user_id, content_session_id, max(coalesce(event_ts_client, event_ts_server)) AS latest_event_ts FROM interactions
  WHERE coalesce(event_ts_client, event_ts_server) <= '{END}' GROUP BY ALL),
qualified AS (SELECT user_id, news_id, latest_event_ts AS action_ts, (epoch_us(latest_event_ts) - epoch_us(view_ts)) / 1e6 AS dwell_seconds
  FROM uopens JOIN activity USING (user_id, content_session_id) WHERE latest_event_ts >= view_ts AND epoch_us(latest_event_ts) - epoch_us(view_ts) >= 5000000),
kw AS (SELECT news_id, list_sort(list(keyword)) AS keyword_ids FROM news_keyword GROUP BY 1),
st AS (SELECT news_id, list_sort(list(stock_id)) AS stock_ids FROM news_stock GROUP BY 1),
entities AS (SELECT q.*, coalesce(keyword_ids, []) AS keyword_ids, coalesce(stock_ids, []) AS stock_ids FROM qualified q LEFT JOIN kw USING (news_id) LEFT JOIN st USING (news_id)),
actions AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY action_ts DESC, news_id DESC, dwell_seconds DESC) AS row_num FROM entities QUALIFY row_num <= 20),
changed AS (SELECT DISTINCT user_id FROM interactions WHERE event_ts_server >= '{START}' AND event_ts_server < '{END}'),
rewards AS (SELECT DISTINCT request_id, user_id, news_id FROM sessions WHERE dwell_seconds >= 5),
impu AS (SELECT request_id, user_id, news_id, path FROM items QUALIFY row_number() OVER (PARTITION BY request_id, user_id, news_id ORDER BY position, id, path) = 1),
gpost AS (SELECT path, sum(dwell_5s_count)::BIGINT AS reward_count, sum(impression_count)::BIGINT AS impression_count FROM tot WHERE path <> 'TOTAL' GROUP BY path),
upost AS (SELECT user_id, path, count(r.request_id) AS reward_count, count(*) AS impression_count FROM impu LEFT JOIN rewards r USING (request_id, user_id, news_id) GROUP BY user_id, path),
arms AS (SELECT * FROM (VALUES ('A1', 'onboarding'), ('A2', 'behavior'), ('B', 'breaking'), ('C', 'popular')) t(path, arm)),
state AS (SELECT 'global' AS scope, NULL::BIGINT AS user_id, arm AS path, reward_count::DOUBLE AS alpha, greatest(impression_count - reward_count, 0)::DOUBLE AS beta, reward_count, impression_count, TIMESTAMP '{END}' AS window_end FROM gpost JOIN arms USING (path)
  UNION ALL SELECT 'user', user_id, arm, reward_count::DOUBLE, greatest(impression_count - reward_count, 0)::DOUBLE, reward_count, impression_count, TIMESTAMP '{END}' FROM upost JOIN arms USING (path))
"""


def six(frame, *columns):
    """Rounds columns to 6 places, as sums depend on their order beyond that."""
    return frame.withColumns({c: F.round(c, 6) for c in columns})


def _items(s, p):
    return d.explode_served_items(a.serves(s, p), START, END)


def _opens(s, p):
    return d.open_events(a.interactions(s, p), START, END)


def _leaves(s, p):
    return d.leave_events(a.interactions(s, p), START, END)


def _sessions(s, p):
    return d.dwell_sessions(_opens(s, p), _leaves(s, p))


def metrics(s, p):
    return d.hourly_path_metrics(a.serves(s, p), a.interactions(s, p), START, END)


def _paths(s, p):
    return d.path_metrics(d.dedup_impressions(_items(s, p)), d.click_metrics(_opens(s, p)), d.dwell_metrics(_sessions(s, p)), START, END)


def _users(s, p):
    return d.changed_users(a.interactions(s, p), START, END)


def _qualified(s, p):
    i, u = a.interactions(s, p), _users(s, p)
    return d.qualified_sessions(d.user_opens(i, u), d.session_activity(i, u, END))


def _entities(s, p):
    return d.session_entities(_qualified(s, p), a.news_keyword(s, p), a.news_stock(s, p))


def snapshot(s, p, keep=lambda frame: frame):
    return d.a2_snapshot(a.interactions(s, p), a.news_keyword(s, p), a.news_stock(s, p), START, END, keep=keep)


def _scored(s, p):
    base = d.ctr_base(metrics(s, p), END, HOURS)
    return d.smoothed_ctr(base, d.global_prior_ctr(base))


def state(s, p):
    return d.update_bandit_state(a.serves(s, p), a.interactions(s, p), metrics(s, p), END, HOURS)


QUERIES = {
    "d01_explode_served_items": _items,
    "d02_dedup_impressions": lambda s, p: d.dedup_impressions(_items(s, p)),
    "d02u_dedup_impressions_by_user": lambda s, p: d.dedup_impressions(_items(s, p), True),
    "d03_open_events": _opens,
    "d04_click_metrics": lambda s, p: d.click_metrics(_opens(s, p)),
    "d05_leave_events": _leaves,
    "d06_dwell_sessions": lambda s, p: six(_sessions(s, p), "dwell_seconds"),
    "d07_dwell_metrics": lambda s, p: six(d.dwell_metrics(_sessions(s, p)), "sum_log_dwell_time"),
    "d08_path_metrics": lambda s, p: six(_paths(s, p), "sum_log_dwell_time"),
    "d09_with_total": lambda s, p: six(d.with_total(_paths(s, p)), "sum_log_dwell_time"),
    "d10_hourly_path_metrics": lambda s, p: six(metrics(s, p), "sum_log_dwell_time"),
    "d11_changed_users": _users,
    "d12_user_opens": lambda s, p: d.user_opens(a.interactions(s, p), _users(s, p)),
    "d13_session_activity": lambda s, p: d.session_activity(a.interactions(s, p), _users(s, p), END),
    "d14_qualified_sessions": lambda s, p: six(_qualified(s, p), "dwell_seconds"),
    "d15_session_entities": lambda s, p: six(_entities(s, p), "dwell_seconds"),
    "d16_ranked_actions": lambda s, p: six(d.ranked_actions(_entities(s, p)), "dwell_seconds"),
    "d17_a2_items": lambda s, p: snapshot(s, p).select("user_id", "snapshot_at", F.get_json_object("items", "$[*].news_id").alias("news_ids")),
    "d18_recent_actions": lambda s, p: six(d.recent_actions(snapshot(s, p), 20), "dwell_seconds"),
    "d19_ctr_base": lambda s, p: d.ctr_base(metrics(s, p), END, HOURS),
    "d20_global_prior_ctr": lambda s, p: six(d.global_prior_ctr(d.ctr_base(metrics(s, p), END, HOURS)), "prior_ctr"),
    "d21_smoothed_ctr": lambda s, p: six(_scored(s, p), "score"),
    "d22_popular_top": lambda s, p: d.popular_top(_scored(s, p), END),
    "d23_global_posteriors": lambda s, p: d.global_posteriors(metrics(s, p), END, HOURS),
    "d24_dwell_rewards": lambda s, p: d.dwell_rewards(a.interactions(s, p), START, END),
    "d25_user_posteriors": lambda s, p: d.user_posteriors(d.dedup_impressions(_items(s, p), True), d.dwell_rewards(a.interactions(s, p), START, END)),
    "d26_to_posterior": lambda s, p: d.to_posterior(d.global_posteriors(metrics(s, p), END, HOURS), END, HOURS),
    "d27_update_bandit_state": state,
    "d28_bandit_lookup": lambda s, p: d.bandit_lookup(state(s, p), a.interactions(s, p), list(d.ARMS.values())),
    "d29_read_news": lambda s, p: d.read_news(a.interactions(s, p), END, 31),
    "d30_recent_serves": lambda s, p: d.recent_serves(a.serves(s, p), END, HOURS),
    "d31_request_count": lambda s, p: d.request_count(a.serves(s, p)),
}
_DWELLS = "dwell_event_count, dwell_5s_count, dwell_30s_count, round(sum_log_dwell_time, 6) AS sum_log_dwell_time"
_METRICS = "bucket_start, bucket_end, news_id, path, impression_count, click_count, " + _DWELLS
ORACLES = {k: SQL_D + v for k, v in {
    "d01_explode_served_items": "SELECT request_id, user_id, news_id, path, position, id FROM items",
    "d02_dedup_impressions": "SELECT * FROM imp",
    "d02u_dedup_impressions_by_user": "SELECT * FROM impu",
    "d03_open_events": "SELECT * FROM opens",
    "d04_click_metrics": "SELECT * FROM clicks",
    "d05_leave_events": "SELECT * FROM leaves",
    "d06_dwell_sessions": "SELECT * REPLACE (round(dwell_seconds, 6) AS dwell_seconds) FROM sessions",
    "d07_dwell_metrics": f"SELECT request_id, user_id, news_id, {_DWELLS} FROM dwells",
    "d08_path_metrics": f"SELECT {_METRICS} FROM pm",
    "d09_with_total": f"SELECT {_METRICS} FROM tot",
    "d10_hourly_path_metrics": f"SELECT {_METRICS} FROM tot",
    "d11_changed_users": "SELECT * FROM changed",
    "d12_user_opens": "SELECT * FROM uopens",
    "d13_session_activity": "SELECT * FROM activity",
    "d14_qualified_sessions": "SELECT * REPLACE (round(dwell_seconds, 6) AS dwell_seconds) FROM qualified",
    "d15_session_entities": "SELECT * REPLACE (round(dwell_seconds, 6) AS dwell_seconds) FROM entities",
    "d16_ranked_actions": "SELECT * REPLACE (round(dwell_seconds, 6) AS dwell_seconds) FROM actions",
    "d17_a2_items": f"SELECT user_id, TIMESTAMP '{END}' AS snapshot_at, ids AS news_ids FROM changed LEFT JOIN (SELECT user_id, CASE WHEN count(*) = 1 THEN min(news_id)::VARCHAR ELSE '[' || string_agg(news_id, ',' ORDER BY row_num) || ']' END AS ids FROM actions GROUP BY 1) USING (user_id)",
    "d18_recent_actions": "SELECT user_id, row_num - 1 AS pos, news_id, action_ts, round(dwell_seconds, 6) AS dwell_seconds, keyword_ids, stock_ids FROM actions",
    "d19_ctr_base": "SELECT * FROM ctr",
    "d20_global_prior_ctr": "SELECT round(prior_ctr, 6) AS prior_ctr FROM prior",
    "d21_smoothed_ctr": "SELECT news_id, impression_count, click_count, round(score, 6) AS score FROM scored",
    "d22_popular_top": f"SELECT TIMESTAMP '{END}' AS snapshot_at, list(news_id ORDER BY score DESC, click_count DESC, impression_count DESC, news_id DESC) AS news_ids FROM (FROM scored ORDER BY score DESC, click_count DESC, impression_count DESC, news_id DESC LIMIT 500)",
    "d23_global_posteriors": "SELECT * FROM gpost",
    "d24_dwell_rewards": "SELECT * FROM rewards",
    "d25_user_posteriors": "SELECT * FROM upost",
    "d26_to_posterior": "SELECT path, reward_count, impression_count, alpha, beta, window_end - INTERVAL 744 HOUR AS window_start, window_end FROM state WHERE scope = 'global'",
    "d27_update_bandit_state": "SELECT * FROM state",
    "d28_bandit_lookup": "SELECT u.user_id, a.arm AS path, coalesce(alpha, 0) AS alpha, coalesce(beta, 0) AS beta FROM (SELECT DISTINCT user_id FROM interactions UNION ALL SELECT NULL) u CROSS JOIN arms a LEFT JOIN state s ON s.user_id IS NOT DISTINCT FROM u.user_id AND s.path = a.arm",
    "d29_read_news": """, lv AS (SELECT user_id, content_session_id, max(coalesce(event_ts_client, event_ts_server)) AS leave_ts FROM interactions WHERE event_type = 'content_leave' GROUP BY ALL),
      rd AS (SELECT user_id, news_id, max(view_ts) AS open_ts FROM uopens JOIN lv USING (user_id, content_session_id) WHERE epoch_us(leave_ts) - epoch_us(view_ts) >= 5000000 GROUP BY ALL)
      SELECT user_id, news_id, open_ts, row_number() OVER (PARTITION BY user_id ORDER BY open_ts DESC, news_id DESC) AS rank FROM rd QUALIFY rank <= 1000""",
    "d30_recent_serves": "SELECT user_id, news_id, max(created_at) AS last_served_at, count(*) AS serve_count FROM items GROUP BY ALL",
    "d31_request_count": "SELECT user_id, count(DISTINCT request_id) AS requests FROM served GROUP BY 1",
}.items()}
