"""Queries for the alert rules by experiment and variant."""

from __future__ import annotations

from millrace.operators import alerts as al
from millrace.plans.evaluate import SQL_J, ntz, requests, six

#: Thresholds for a log of few requests, whose shares stay low under the denominator of one a second.
QUIET = {"errors": (0.0, 10), "latency": (0.3, 10), "fallback": (0.0, 15), "empty": (0.0, 15)}


def _cells(s, p):
    return al.cells(requests(s, p))


def _series(s, p):
    return al.alert_series(_cells(s, p))


QUERIES = {
    "j03_latency_p95": lambda s, p: ntz(six(_series(s, p).filter("alert = 'latency'").drop("alert"), "rate"), "window_start"),
    "j04_alert_series": lambda s, p: ntz(six(_series(s, p), "rate"), "window_start"),
    "j05_firing": lambda s, p: ntz(al.firing(_series(s, p), QUIET), "start", "end"),
    "j05_firing_as_deployed": lambda s, p: ntz(al.firing(_series(s, p)), "start", "end"),
}

SERIES = f"""{SQL_J},
lim AS (SELECT unnest({list(al.BUCKETS)})::DOUBLE AS le),
hist AS (SELECT variant, window_start, le, count(*) FILTER (latency_ms <= le * 1000) AS n, count(*) AS total FROM wins, lim WHERE NOT error GROUP BY ALL),
steps AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before FROM hist WINDOW w AS (PARTITION BY variant, window_start ORDER BY le)),
p95 AS (
  SELECT variant, window_start, coalesce(min(low + (le - low) * (0.95::DOUBLE * total - before) / (n - before)) FILTER (n >= 0.95::DOUBLE * total AND before < 0.95::DOUBLE * total), 10) AS rate
  FROM steps GROUP BY variant, window_start),
late AS (
  SELECT variant, moment AS window_start, count(*) FILTER (NOT error) AS good, count(*) FILTER (NOT error AND fallback_used) AS fallbacks, count(*) FILTER (NOT error AND returned = 0) AS empty
  FROM (SELECT *, unnest([window_start, window_start + INTERVAL 5 MINUTE, window_start + INTERVAL 10 MINUTE]) AS moment FROM wins) GROUP BY variant, moment),
series AS (
  SELECT 'errors' AS alert, 'all' AS experiment_id, 'all' AS variant, window_start, count(*) FILTER (error) / 300.0::DOUBLE / greatest(count(*) / 300.0::DOUBLE, 1) AS rate FROM wins GROUP BY window_start
  UNION ALL SELECT 'latency', 'exp', variant, window_start, rate FROM p95
  UNION ALL SELECT 'fallback', 'exp', variant, window_start, fallbacks / 900.0::DOUBLE / greatest(good / 900.0::DOUBLE, 1) FROM late
  UNION ALL SELECT 'empty', 'exp', variant, window_start, empty / 900.0::DOUBLE / greatest(good / 900.0::DOUBLE, 1) FROM late)"""


def _firing_sql(rules):
    values = ", ".join(f"('{name}', {limit}, {minutes})" for name, (limit, minutes) in rules.items())
    return f"""{SERIES}, rules(alert, lim, minutes) AS (VALUES {values}),
runs AS (
  SELECT series.*, minutes, window_start - to_minutes(5 * row_number() OVER (PARTITION BY alert, experiment_id, variant ORDER BY window_start)) AS run
  FROM series JOIN rules USING (alert) WHERE rate > lim)
SELECT alert, experiment_id, variant, min(window_start) AS start, max(window_start) + INTERVAL 5 MINUTE AS "end"
FROM runs GROUP BY alert, experiment_id, variant, minutes, run HAVING count(*) * 5 >= minutes"""


ORACLES = {
    "j03_latency_p95": f"{SERIES} SELECT 'exp' AS experiment_id, variant, window_start, round(rate, 6) AS rate FROM p95",
    "j04_alert_series": f"{SERIES} SELECT alert, experiment_id, variant, window_start, round(rate, 6) AS rate FROM series",
    "j05_firing": _firing_sql(QUIET),
    "j05_firing_as_deployed": _firing_sql(al.RULES),
}
