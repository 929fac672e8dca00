"""Alert rules by experiment and variant against plain Python over made-up logs."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.operators import alerts

SCHEMA = "ts timestamp, latency_ms int, fallback_used boolean, returned int, error boolean, experiment_id string, variant string"
BASE = dt.datetime(2024, 1, 1)


def plain_p95(latencies):
    rank = 0.95 * len(latencies)
    low = before = 0
    for limit in alerts.BUCKETS:
        n = sum(x is not None and x <= limit * 1000 for x in latencies)
        if n >= rank:
            return low + (limit - low) * (rank - before) / (n - before)
        low, before = limit, n
    return alerts.BUCKETS[-1]


def log(seed, n):
    draw = random.Random(seed)
    pick = draw.choice
    return [
        (BASE + dt.timedelta(seconds=draw.randrange(5400)), pick([1, 30, 90, 700, 2600, 9000, 20000, None]), pick([True, False, None]), pick([0, 3, None]), pick([True, False, False, None]), pick(["x", None]), pick(["a", "b"]))
        for _ in range(n)
    ]


def test_series(spark):
    rows = log(1, 900) + [(None, 5, True, 0, False, "x", "a")]
    got = {(r.alert, r.experiment_id, r.variant, int((r.window_start - BASE).total_seconds() // 300)): r.rate for r in alerts.alert_series(alerts.cells(spark.createDataFrame(rows, SCHEMA))).collect()}
    late, wide, every = defaultdict(list), defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
    for ts, ms, fallback, returned, error, experiment, variant in rows[:-1]:
        cell, key = int((ts - BASE).total_seconds() // 300), (experiment or "none", variant)
        every[cell][0] += bool(error)
        every[cell][1] += 1
        for i in range(3):
            wide[(*key, cell + i)][0] += not error
            wide[(*key, cell + i)][1] += not error and fallback is True
            wide[(*key, cell + i)][2] += not error and returned == 0
        if not error:
            late[(*key, cell)].append(ms)
    want = {("errors", "all", "all", c): e / 300 / max(n / 300, 1) for c, (e, n) in every.items()}
    want |= {("latency", *k): plain_p95(v) for k, v in late.items()}
    for i, name in ((1, "fallback"), (2, "empty")):
        want |= {(name, *k): v[i] / 900 / max(v[0] / 900, 1) for k, v in wide.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cells_add_up(spark):
    """Cells of two halves of a log, added, are those of the whole."""
    whole = spark.createDataFrame(log(2, 300), SCHEMA)
    half = whole.withColumn("half", F.pmod(F.xxhash64("ts"), F.lit(2)))
    numbers = ["requests", "errors", "fallbacks", "empty", *[f"below[{i}]" for i in range(len(alerts.BUCKETS))]]
    both = alerts.cells(half.filter("half = 0")).unionByName(alerts.cells(half.filter("half = 1")))
    added = lambda f: {tuple(r) for r in f.groupBy("start", *alerts.LABELS).agg(*[F.sum(F.expr(n)) for n in numbers]).collect()}
    assert added(both) == added(alerts.cells(whole))


def test_firing(spark):
    at = lambda i: BASE + dt.timedelta(minutes=5 * i)
    series = [("latency", "x", "a", at(i), 2.5) for i in (0, 1, 4, 6, 7, 8)] + [("latency", "x", "b", at(2), 9.0), ("latency", "x", "b", at(3), 2.0), ("empty", "x", "a", at(0), 0.2), ("empty", "x", "a", at(1), 0.2), ("other", "x", "a", at(0), 9.0), ("other", "x", "a", at(1), 9.0)]
    frame = spark.createDataFrame(series, "alert string, experiment_id string, variant string, window_start timestamp, rate double")
    got = sorted((r.alert, r.variant, r.start, r.end) for r in alerts.firing(frame).collect())
    assert got == [("latency", "a", at(0), at(2)), ("latency", "a", at(6), at(9))]
    assert not alerts.firing(frame.limit(0)).collect() and not alerts.alert_series(alerts.cells(spark.createDataFrame([], SCHEMA))).collect()
