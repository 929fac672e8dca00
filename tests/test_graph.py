"""Pairs of nodes that share news, where some news have very many, and the random split of links, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph

EDGES = "src long, dst long"


def edges(seed, news, nodes, hot):
    draw = random.Random(seed)
    pairs = {(draw.randrange(news), draw.randrange(nodes)) for _ in range(news * 3)} | {(0, i) for i in range(hot)}
    rows = sorted(pairs)
    return rows + rows[:7]  # repeated edges count once


@pytest.mark.parametrize("span", [3, 1024])
def test_shared_news_in_blocks(spark, span):
    k, s = edges(1, 30, 40, 40), edges(2, 30, 25, 17)
    left = spark.createDataFrame([*k, (None, 5)], EDGES).select(F.col("src").alias("news"), F.col("dst").alias("src")).distinct()
    right = spark.createDataFrame([*s, (None, 6)], EDGES).select(F.col("src").alias("news"), "dst").distinct()
    plain = Counter((a, b) for n, a in set(k) for m, b in set(s) if n == m)
    assert Counter(tuple(r) for r in graph.shared_news(left, right, span=span).collect()) == plain
    own = Counter((a, b) for n, a in set(s) for m, b in set(s) if n == m and a < b)
    again = right.select("news", F.col("dst").alias("src"))
    assert Counter(tuple(r) for r in graph.shared_news(again, right, True, span).collect()) == own
    assert not graph.shared_news(left.limit(0), right, span=span).collect() and not graph.shared_news(again, right.limit(0), True, span).collect()


def test_hot_news_meet_in_bounded_groups(spark):
    """4,000 nodes of one news: no key of the join holds much more than a block of either side."""
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("news"), F.col("id").alias("src"))
    pairs = graph.shared_news(rows, rows.withColumnRenamed("src", "dst"), True, 256)
    assert pairs.count() == 4000 * 3999 // 2
    counted = graph.relation_pairs(spark.range(300).select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst")), spark.createDataFrame([(1, 0), (1, 1)], EDGES), 1)
    assert Counter(r.relation for r in counted.collect()) == {"key2stock": 600, "stock2stock": 2, "key2key": 300 * 299}


def test_random_link_split(spark):
    positives = spark.createDataFrame([(i, i * 7 % 50) for i in range(400)], EDGES)
    out = [tuple(r) for r in graph.random_link_split(positives, 400, 50, 0.1, 0.2, 3).collect()]
    sizes = Counter((split, label) for _, _, split, label in out)
    assert all(sizes[x, 0] == sizes[x, 1] > 0 for x in ("train", "val", "test")) and len({(a, b) for a, b, _, _ in out}) == len(out) == 800
    assert {(a, b) for a, b, _, y in out if y} == {(r.src, r.dst) for r in positives.collect()}
    assert out and {tuple(r) for r in graph.random_link_split(positives.repartition(3), 400, 50, 0.1, 0.2, 3).collect()} == set(out)
    assert not graph.random_link_split(positives.limit(0), 400, 50, 0.1, 0.2, 3).collect()


def test_negatives_take_no_more_draws_than_they_need(spark):
    """The first pairs of all draws, from little more draws than pairs on a sparse graph and from all of them on a full one."""
    import re
    from hashlib import md5

    def plain(positives, num_src, num_dst, count):
        draw = lambda of, i, n: int(md5(f"5:{of}:{i}".encode()).hexdigest()[:15], 16) % n
        pairs = ((draw("s", i, num_src), draw("d", i, num_dst)) for i in range(max(20 * count, 1000)))
        return list(dict.fromkeys(p for p in pairs if p not in positives))[:count]

    sparse = {(i, i * 7 % 500) for i in range(4000)}
    made = graph.negative_edges(spark.createDataFrame(sorted(sparse), EDGES), 4000, 500, 4000, 5)
    assert {tuple(r) for r in made.collect()} == {*plain(sparse, 4000, 500, 4000)} and made.count() == 4000
    assert max(int(n) for n in re.findall(r"Range \(0, (\d+)", made._jdf.queryExecution().optimizedPlan().toString())) < 3 * 4000
    full = {(i, j) for i in range(60) for j in range(20) if (i + j) % 40}
    edges = spark.createDataFrame(sorted(full), EDGES)
    wanted = plain(full, 60, 20, len(full))
    assert 0 < len(wanted) < len(full) and {tuple(r) for r in graph.negative_edges(edges, 60, 20, len(full), 5).collect()} == {*wanted}
    split = graph.random_link_split(edges, 60, 20, 0.1, 0.2, 5).filter("label = 0").collect()
    sizes = Counter(r.split for r in graph.random_split(edges, 0.1, 0.2, 5).collect())
    assert {(r.src, r.dst) for r in split if r.split == "train"} == {*wanted[: sizes["train"]]} and len(split) == len(wanted)


@pytest.mark.parametrize("span", [3, 1024])
def test_news_named_by_two_columns(spark, span):
    """Articles of one id are apart, in blocks and without, and rows that lie by news are not dealt out again to meet."""
    k, s = {(n % 15, n % 2, x) for n, x in edges(3, 30, 40, 40)}, {(n % 15, n % 2, x) for n, x in edges(4, 30, 25, 17)}
    left, right = spark.createDataFrame(sorted(k), "news_id long, nth long, src long"), spark.createDataFrame(sorted(s), "news_id long, nth long, dst long")
    pairs = graph.shared_news(left, right, span=span)
    assert Counter(tuple(r) for r in pairs.collect()) == Counter((a, b) for *n, a in k for *m, b in s if n == m)
    own = graph.shared_news(right.withColumnRenamed("dst", "src"), right, True, span)
    assert Counter(tuple(r) for r in own.collect()) == Counter((a, b) for *n, a in s for *m, b in s if n == m and a < b)
