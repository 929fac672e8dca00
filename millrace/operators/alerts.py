"""Alert rules over the request log by experiment and variant (J3 to J5): cells of five minutes that add up to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits of the latency buckets in seconds, and (threshold, minutes it must last) of each alert.
BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
RULES = {"errors": (0.05, 10), "latency": (2.0, 10), "fallback": (0.5, 15), "empty": (0.1, 15)}
STEP = 5
LABELS = ("experiment_id", "variant")


def cells(requests: DataFrame) -> DataFrame:
    """One row for each five minutes, experiment and variant: ``start``, requests, errors, fallbacks, empty results and
    ``below``, the successful requests up to each latency limit; those of windows are their sums.

    Only successful requests have a latency, a fallback or an empty result. Missing labels are 'none'; rows without a
    time are left out, and a missing latency is above all limits.
    """
    good = ~F.coalesce("error", F.lit(False))
    below = [F.count_if(good & (F.col("latency_ms") <= b * 1000)) for b in BUCKETS]
    labels = [F.coalesce(F.col(c), F.lit("none")).alias(c) for c in LABELS]
    return requests.filter("ts IS NOT NULL").groupBy(F.window("ts", f"{STEP} minutes")["start"].alias("start"), *labels).agg(
        F.count("*").alias("requests"), F.count_if(~good).alias("errors"), F.count_if(good & F.col("fallback_used")).alias("fallbacks"),
        F.count_if(good & (F.col("returned") == 0)).alias("empty"), F.array(*below).alias("below"),
    )


def quantile(below: Column, total: Column, q: float) -> Column:
    """The quantile by straight lines between the limits; the last limit where it lies above all, null without requests.

    ``below`` counts the requests up to each of ``BUCKETS``.
    """
    limits, rank = F.array(*map(F.lit, BUCKETS)), total * q
    at = F.size(F.filter(below, lambda n: n < rank))  # buckets under the rank, so the place of the one that holds it
    low, before = F.coalesce(F.get(limits, at - 1), F.lit(0.0)), F.coalesce(F.get(below, at - 1), F.lit(0))
    inside = low + (F.get(limits, at) - low) * (rank - before) / (F.get(below, at) - before)
    return F.when(total > 0, F.coalesce(inside, F.lit(BUCKETS[-1])))


def alert_series(cells: DataFrame) -> DataFrame:
    """(alert, experiment_id, variant, window_start, rate): what the rules compare, by the last five minutes of a window.

    Errors of all requests over five minutes ('all' as labels), the 95 % quantile of latency in seconds over five, fallbacks
    and empty results of the successful requests over fifteen. Shares are of per-second rates, the denominator at least 1.
    """
    per = lambda n, of, minutes: n / (60.0 * minutes) / F.greatest(of / (60.0 * minutes), F.lit(1.0))
    successes = F.col("requests") - F.col("errors")
    named = [F.lit("all").alias(c) for c in LABELS]
    every = cells.groupBy("start").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
    errors = every.select(F.lit("errors").alias("alert"), *named, F.col("start").alias("window_start"), per(F.col("errors"), F.col("requests"), STEP).alias("rate"))
    p95 = cells.select(F.lit("latency").alias("alert"), *LABELS, F.col("start").alias("window_start"), quantile(F.col("below"), successes, 0.95).alias("rate")).filter("rate IS NOT NULL")
    ends = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("start") + F.make_interval(mins=i * STEP))
    wide = cells.select(*LABELS, F.explode(ends).alias("window_start"), successes.alias("of"), "fallbacks", "empty")
    sums = wide.groupBy(*LABELS, "window_start").agg(*[F.sum(c).alias(c) for c in ("of", "fallbacks", "empty")])
    shares = F.array(*[F.struct(F.lit(n).alias("alert"), per(F.col(c), F.col("of"), 3 * STEP).alias("rate")) for n, c in (("fallback", "fallbacks"), ("empty", "empty"))])
    late = sums.select(*LABELS, "window_start", F.explode(shares).alias("x")).select("x.alert", *LABELS, "window_start", "x.rate")
    return errors.unionByName(p95).unionByName(late)


def firing(series: DataFrame, rules: dict[str, tuple[float, int]] = RULES) -> DataFrame:
    """(alert, experiment_id, variant, start, end): runs of adjoining windows above the alert's threshold that last its minutes.

    Alerts without a rule never fire; each window counts for its last five minutes.
    """
    above = long = F.lit(False)
    for name, (limit, minutes) in rules.items():
        above = above | ((F.col("alert") == name) & (F.col("rate") > limit))
        long = long | ((F.col("alert") == name) & (F.col("n") * STEP >= minutes))
    keys = ["alert", *LABELS]
    place = F.row_number().over(W.partitionBy(*keys).orderBy("window_start"))
    run = series.filter(above).withColumn("run", F.unix_seconds(F.col("window_start").cast("timestamp")) - place * STEP * 60)
    runs = run.groupBy(*keys, "run").agg(F.min("window_start").alias("start"), F.max("window_start").alias("last"), F.count("*").alias("n"))
    return runs.filter(long).select(*keys, "start", (F.col("last") + F.make_interval(mins=F.lit(STEP))).alias("end"))
