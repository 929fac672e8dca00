"""Small exact cases of the platform's own operators."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import behaviour, evaluate, funnel, graph, lake, retrieval


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


def test_fixed_mix(spark):
    arms = {"onboarding": [101, 102, 103], "behavior": [201, 202], "breaking": [301, 302], "popular": [401]}
    given = frame(spark, [(1, p, i, n) for p, ns in arms.items() for i, n in enumerate(ns)], "user_id long, path string, pos int, news_id long")
    got = retrieval.fixed_mix(given, {"onboarding": 2, "behavior": 2, "breaking": 1, "popular": 1}).orderBy("pos").collect()
    assert [r.news_id for r in got] == [101, 102, 201, 202, 301, 401, 103, 302]


def test_thompson_mean(spark):
    arms = {"onboarding": [101, 102], "behavior": [201, 202, 203, 204], "breaking": [301], "popular": [401]}
    given = frame(spark, [(7, p, i, n) for p, ns in arms.items() for i, n in enumerate(ns)], "user_id long, path string, pos int, news_id long")
    counts = {"onboarding": (1, 4), "behavior": (10, 3), "breaking": (1, 5), "popular": (1, 6)}
    params = frame(spark, [(7, p, 2.0 + a, 2.0 + b) for p, (a, b) in counts.items()], "user_id long, path string, alpha double, beta double")
    got = retrieval.thompson_mix(given, params, "mean", batch=8, least=1).orderBy("pos").collect()
    assert [(r.news_id, r.path) for r in got[:2]] == [(201, "behavior"), (101, "onboarding")] and {r.path for r in got} == set(arms)
    sampled = [retrieval.thompson_mix(given.repartition(n), params, seed=3).orderBy("pos").collect() for n in (1, 5)]
    assert sampled[0] == sampled[1] and sorted(r.news_id for r in sampled[0]) == sorted(n for ns in arms.values() for n in ns)


def test_posteriors(spark):
    got = behaviour.to_posterior(frame(spark, [("A1", 7, 10), ("B", 1, 5), ("TOTAL", 1, 1)], "path string, reward_count long, impression_count long"), "2026-03-10 00:00:00")
    assert sorted((r.path, r.alpha, r.beta) for r in got.collect()) == [("breaking", 1.0, 4.0), ("onboarding", 7.0, 3.0)]


def test_exposure(spark):
    ranked = frame(spark, [(1, 10, None, 1), (1, 9, None, 2), (1, 8, None, 3)], "user_id long, news_id long, score double, rank int")
    served = frame(spark, [(1, 10, 3, "2024-01-01 10:00:00")], "user_id long, news_id long, serve_count long, last_served_at string").withColumn("last_served_at", F.col("last_served_at").cast("timestamp_ntz"))
    none = frame(spark, [], "user_id long, news_id long")
    excluded, multipliers = retrieval.suppression(none, none, served, "2024-01-01 12:00:00")
    assert excluded.count() == 0
    assert [r.news_id for r in retrieval.apply_exposure_penalty(ranked, multipliers).orderBy("new_rank").collect()] == [9, 8, 10]
    assert retrieval.suppression(none, none, served, "2024-01-01 10:30:00")[0].count() == 1


def test_variants(spark):
    slots = retrieval.variant_slots("recommend:8,latest:1,popular:1")
    assert len(slots) == 10 and retrieval.variant_slots("a:x,b,c:2") == ["b", "c", "c"]
    requests = frame(spark, [(1, f"r{i:02}", i, None) for i in range(16)], "user_id long, request_id string, ts int, override string")
    got = [r.variant for r in retrieval.assign_variant(requests, slots).orderBy("ts").collect()]
    assert got == ["recommend"] * 13 + ["latest", "popular", "recommend"]


def test_post_filter(spark):
    refined = frame(spark, [(1, "mapped news"), (2, "alpha beta gamma"), (3, "unrelated")], "news_id long, text string")
    stocks = frame(spark, [(1,)], "news_id long")
    assert rows(funnel.post_filter(refined, stocks, ["alpha", "beta", "gamma"], [])) == [(1,), (2,)]
    assert funnel.post_filter(refined, stocks, [], []).count() == 3


def test_split(spark):
    times = frame(spark, [(0, 1735689600), (1, 1739145600), (2, 1740787200)], "idx long, pub_ts long")
    edges = frame(spark, [(0, 0), (1, 1), (2, 1)], "src long, dst long")
    split = graph.temporal_split(edges, times, *graph.date_bounds("2025-01-31", "2025-02-15"))
    assert rows(split) == [(0, 0, "train"), (1, 1, "val"), (2, 1, "test")]
    assert rows(graph.message_edges(split, "test")) == [(0, 0)] and graph.message_edges(split, "test", online=True).count() == 3
    with pytest.raises(ValueError):
        graph.date_bounds("2025-02-15", "2025-01-31")


def test_frequency_filter(spark):
    edges = frame(spark, [(0, 0), (1, 0), (2, 1)], "src long, dst long")
    kept, mapping = graph.filter_low_degree(edges, 2)
    assert rows(kept) == [(0, 0), (1, 0)] and rows(mapping.select("dst", "new_idx")) == [(0, 0)]


def test_negatives_are_no_positives(spark):
    positives = frame(spark, [(i % 20, i % 7) for i in range(60)], "src long, dst long").distinct()
    got = graph.negative_edges(positives, 20, 7, 15, 3)
    assert got.count() == 15 and got.join(positives, ["src", "dst"]).count() == 0
    assert rows(got) == rows(graph.negative_edges(positives.repartition(7), 20, 7, 15, 3))


@pytest.mark.parametrize("same", [False, True])
def test_every_positive_with_a_free_target_gets_one(spark, monkeypatch, same):
    monkeypatch.setattr(evaluate, "SPAN", 16)
    ids = [3 * i for i in range(60)]
    linked = {0: ids[1:], 3: ids, 6: ids[:2], 9: ids[:3] + ids[4:50] + ids[51:59] + [1000], 12: ids[2:57]}
    truth = frame(spark, [(s, d) for s, found in linked.items() for d in found] + [(6, 0)], "src long, dst long")
    targets = frame(spark, [(i,) for i in ids], "id long")
    free = {s: [i for i in ids if i not in found and not (same and i == s)] for s, found in linked.items()}
    number = lambda *parts: int(hashlib.md5(":".join(map(str, (5, *parts))).encode()).hexdigest()[:15], 16)
    want, late = [], 0
    for s, found in linked.items():
        for d in found if free[s] else []:
            hits = [x for x in (ids[number(s, d, turn) % len(ids)] for turn in range(8)) if x in free[s]]
            late += not hits
            want.append((s, d, hits[0] if hits else free[s][number(s, d, "free") % len(free[s])]))
    assert late > 50 and sorted(map(tuple, evaluate.negative_targets(truth, targets, 5, same).collect())) == sorted(want)
    assert evaluate.negative_targets(truth, targets.limit(0), 5, same).count() == 0


def test_separation_and_gate(spark):
    unit = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vector array<double>")
    truth = frame(spark, [(0, 0, 1), (1, 1, 1)], "src long, dst long, strength long")
    negatives = evaluate.negative_targets(truth, unit, 1, False).select("src", F.col("negative").alias("dst"))
    got = evaluate.separation(evaluate.pair_cosine(truth, unit, unit), evaluate.pair_cosine(negatives, unit, unit)).first()
    assert (got.positive, got.random, got.separation) == (1.0, 0.0, 1.0)
    gates = evaluate.gate(frame(spark, [(0.31, 0), (0.31, 1), (0.23, 0)], "score double, missing int")).collect()
    assert [r.candidate for r in gates] == [True, False, False]


def test_texts(spark):
    text = F.col("text")
    assert value(spark, t.clean_text(text), "[속보] 홍길동 기자 a@b.kr 삼성전자 &amp; x=1 http://x.y 상승 ※ 끝") == "삼성전자 & 상승"
    assert value(spark, t.is_sports(text), "야구 경기 시즌 우승") and not value(spark, t.is_sports(text), "KBO 경기 시즌 우승")
    assert value(spark, t.keep_script_sentences(text), "가나. abc. 다") == "가나. 다."
    assert value(spark, t.parse_vector(text), "[0.5, ,2]") == [0.5, 2.0] and value(spark, t.parse_vector(text), None) == []
    assert value(spark, t.chunk_text(5)(text), "abc.defgh ijk ") == ["abc.", "defgh ", "ijk"]
    assert value(spark, t.url_domain(text), "https://www.a.b:80/x") == "a.b:80" and value(spark, t.url_domain(text), None) == "unknown"


def test_mentions_with_particles(spark):
    names = frame(spark, [("삼성전자", "005930"), ("삼성", "000001")], "name string, stock_id string")
    text = frame(spark, [(1, "삼성전자는 올랐다"), (2, "삼성그룹은 말했다"), (3, "삼성이")], "news_id long, text string")
    assert rows(funnel.find_stock_mentions(text, names)) == [(1, "005930"), (3, "000001")]


def test_mentions_follow_the_pattern(spark):
    """The join with names finds what one pattern of all names finds, over made-up texts of names, endings and signs."""
    known = ["삼성", "삼성전자", "삼성전자 우", "전자 우선", "우선", "a", "a b", "b c", "b c d", "d", "(주)가", "가", "가&", "가 & 나", "나", "현대그룹", "현대", "x.y", "y", "...", "가은", "소"]
    names = frame(spark, [(n, i) for i, n in enumerate(known)], "name string, stock_id int")
    parts = [*known, "은", "에서", "그룹", "팀은", " ", " ", "  ", "&", "(주)", ".", "A B", "기", "\n", "본부의", "_", "1"]
    draw = random.Random(5)
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(1500)]
    data = [(i % 700, x) for i, x in enumerate(made)] + [(2000, None), (2001, ""), (None, "삼성은"), (None, "a b c d"), (3, made[3])]
    text = frame(spark, data, "news_id long, text string").withColumn("name", F.lit("other"))
    pattern = funnel.mention_pattern([n for n in known if n != "..."])
    found = text.select("news_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m")).select("news_id", F.lower("m").alias("name"))
    wanted = found.join(names, "name").select("news_id", "stock_id").distinct()
    as_set = lambda f: {tuple(r) for r in f.collect()}
    assert as_set(funnel.find_stock_mentions(text, names)) == as_set(wanted) and wanted.count() > 1000
    assert not rows(funnel.find_stock_mentions(text, names.limit(0))) and not rows(funnel.find_stock_mentions(text.limit(0), names))


def test_one_name_everywhere(spark):
    """A name in all texts and a text of one name only; a chain of names that overlap from start to end."""
    names = frame(spark, [("a b", 1), ("b a", 2)], "name string, stock_id long")
    text = frame(spark, [(i, "a b") for i in range(300)] + [(-1, "A b " * 3000), (-2, "x B a b")], "news_id long, text string")
    found = rows(funnel.find_stock_mentions(text, names))
    assert sorted(found) == sorted([(i, 1) for i in range(-1, 300)] + [(-2, 2)])


def test_table_maintenance(spark, tmp_path):
    target = frame(spark, [(1, "a", 5), (2, "b", 6)], "k long, v string, other int")
    source = frame(spark, [(2, None), (3, "c")], "k long, v string")
    assert rows(lake.upsert(target, source, ["k"], ["v"]).filter("k <> 2")) == [(1, "a", 5), (3, "c", None)]
    assert lake.upsert(target, source, ["k"], ["v"]).filter("k = 2").first().v is None
    assert lake.update_only(target, source, ["k"], ["v"]).count() == 2
    with pytest.raises(ValueError):
        lake.transition_status(target, target, "odd", "v", "r", "2024-01-01")
    days = frame(spark, [(1, "2024-01-01"), (2, "2024-01-02")], "news_id long, d string").withColumn("pub_date", F.col("d").cast("timestamp_ntz"))
    lake.write_daily(days, f"{tmp_path}/daily")
    lake.write_daily(days.filter("news_id = 2").withColumn("d", F.lit("new")), f"{tmp_path}/daily")
    assert rows(spark.read.parquet(f"{tmp_path}/daily").select("news_id", "d")) == [(1, "2024-01-01"), (2, "new")]
    with open(f"{tmp_path}/s.csv", "wb") as file:
        file.write("isin,name\nKR7005930003,삼성전자\n,x\n".encode("cp949"))
    assert [(r.stock_id, r.name) for r in lake.read_stock_master(spark, f"{tmp_path}/s.csv").collect()] == [("005930", "삼성전자")]
