"""Retrieval of relations, comparison of methods and the report of named entities against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate, retrieval

K = 3


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame_of(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id long, vector array<double>")


def plain_metrics(left, right, truth, negatives, same):
    """H4 and H9 by their definitions, one source after the other."""
    left, right = unit(left), unit(right)
    ranks, hits, recalls, precisions = [], [], [], []
    for src in sorted({a for a, _ in truth}):
        wanted = {b for a, b in truth if a == src}
        scores = {j: float(left[src] @ right[j]) for j in range(len(right)) if not (same and j == src)}
        best = max(scores[j] for j in wanted)
        ranks.append(1 / (1 + sum(x > best + 1e-12 for x in scores.values())))
        top = sorted(scores, key=lambda j: (-scores[j], j))[:K]
        found = [place for place, j in enumerate(top, 1) if j in wanted]
        hits.append(float(bool(found)))
        recalls.append(len(found) / len(wanted))
        precisions.append(sum((n + 1) / place for n, place in enumerate(found)) / min(len(wanted), len(top)))
    mean = lambda pairs: float(np.mean([left[a] @ right[b] for a, b in pairs]))
    near, far = mean(truth), mean(negatives)
    return {
        "positive_sim": near, "random_sim": far, "separation": near - far, "mrr": np.mean(ranks), f"hit_at_{K}": np.mean(hits),
        f"recall_at_{K}": np.mean(recalls), f"map_at_{K}": np.mean(precisions), "query_count": len(ranks),
        "positive_pair_count": len(truth), "random_pair_count": len(negatives),
    }


def test_compare_methods_equals_plain_loops(spark):
    rng, draw = np.random.default_rng(5), random.Random(5)
    keys, stocks = rng.normal(size=(6, 4)), rng.normal(size=(9, 4))
    mixed = sorted({(draw.randrange(6), draw.randrange(9)) for _ in range(14)})
    alike = sorted({(a, b) for a, b in ((draw.randrange(9), draw.randrange(9)) for _ in range(14)) if a != b})
    edges = lambda pairs: spark.createDataFrame(pairs, "src long, dst long")
    frames = {"keyword": frame_of(spark, keys), "stock": frame_of(spark, stocks)}
    relations, drawn = {}, {}
    for name, source, pairs in (("key2stock", "keyword", mixed), ("stock2stock", "stock", alike)):
        made = evaluate.negative_targets(edges(pairs), frames["stock"], 3, source == "stock")
        drawn[name] = [(r.src, r.negative) for r in made.collect()]
        assert len(drawn[name]) == len(pairs) and not set(drawn[name]) & set(pairs)
        relations[name] = (source, "stock", edges(pairs), made)
    empty = edges(mixed).limit(0)
    relations["none"] = ("keyword", "stock", empty, empty.withColumn("negative", F.col("dst")))
    got = {r.name: r.value for r in evaluate.compare_methods({"all": frames, "half": {"stock": frames["stock"]}, "bare": {}}, relations, K).collect()}
    want = {}
    for method, names in (("all", ("key2stock", "stock2stock")), ("half", ("stock2stock",)), ("bare", ())):
        each = [plain_metrics(keys if n == "key2stock" else stocks, stocks, mixed if n == "key2stock" else alike, drawn[n], n == "stock2stock") for n in names]
        want |= {f"{method}_holdout_{n}_{m}": v for n, row in zip(names, each, strict=True) for m, v in row.items()}
        for average, metric in (("avg_separation", "separation"), ("avg_hit_at_k", f"hit_at_{K}"), ("avg_mrr", "mrr")):
            want[f"{method}_holdout_{average}"] = np.mean([row[metric] for row in each]) if each else 0.0
    assert got == pytest.approx(want)


def test_top_k_across_blocks_and_types(spark):
    matrix = np.random.default_rng(1).normal(size=(40, 5))
    sims = unit(matrix) @ unit(matrix).T
    vectors = frame_of(spark, matrix)
    for same in (True, False):
        got = retrieval.top_k_similar(vectors, vectors, 4, 7, same).collect()
        for query in range(40):
            order = sorted((j for j in range(40) if not (same and j == query)), key=lambda j: (-round(sims[query, j], 9), j))[:4]
            assert [r.id for r in sorted((r for r in got if r.query == query), key=lambda r: r.rank)] == order


def test_gold_similarity_filters_across_types_only(spark):
    names = {"keyword": spark.createDataFrame([(0, "chips"), (1, "ships")], "id long, name string"), "stock": spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "id long, name string")}
    vectors = {"keyword": frame_of(spark, [[1, 0], [0.6, 0.8]]), "stock": frame_of(spark, [[1, 0], [0.8, 0.6], [0, 1]])}
    cases = spark.createDataFrame([("keyword", "chips", "stock", "B"), ("keyword", "gone", "stock", "")], "source_type string, source_name string, target_type string, target_name string")
    edges = lambda pairs: spark.createDataFrame(pairs, "src long, dst long")
    linked = {"keyword": edges([(n, 0) for n in range(3)]), "stock": edges([(n, 1) for n in range(3)] + [(0, 0)])}
    line = lambda e: {(r.direction, r.name): r.line for r in evaluate.gold_report(evaluate.gold_similarity(cases, names, vectors, e)).collect()}
    got = line(linked)
    assert got["keyword2stock", "chips"] == "- chips: B (0.8000)"
    assert got["keyword2keyword", "chips"] == "- chips: ships (0.6000)"
    assert got["stock2keyword", "B"] == "- B: chips (0.8000)"
    assert got["stock2stock", "B"] == "- B: A (0.8000), C (0.6000)"
    assert got["keyword2stock", "gone"] == got["keyword2keyword", "gone"] == "- gone: NOT_FOUND"
    assert len(got) == 6
    assert line({"keyword": edges([(0, 0)]), "stock": edges([(0, 0)]).limit(0)})["keyword2stock", "chips"] == "- chips: A (1.0000), B (0.8000), C (0.0000)"


def test_rank_metrics_without_one_side_are_zero(spark):
    rows = [("a", 0.9, 1), ("a", 0.5, 1), ("b", 0.9, 0), ("c", 0.4, 1), ("c", 0.6, 0)]
    frame = evaluate.explicit_rank_metrics(spark.createDataFrame(rows, "type string, score double, label int"), 1)
    assert {r.type: (r.mrr, r.hit) for r in frame.collect()} == {"a": (0.0, 0.0), "b": (0.0, 0.0), "c": (0.5, 0.0)}
    mean = evaluate.mean_rank_metrics(frame).first()
    assert mean.mrr == pytest.approx(1 / 6) and mean.hit == 0


def test_diversity_takes_unit_vectors(spark):
    rows = [("a", [3.0, 0.0]), ("a", [0.0, 5.0]), ("one", [1.0, 2.0])]
    got = {r.type: (r.similarity, r.variance) for r in evaluate.diversity(spark.createDataFrame(rows, "type string, vector array<double>")).collect()}
    assert got["one"] == (0.0, 0.0) and got["a"] == (pytest.approx(0), pytest.approx(0.5))


def test_golden_ranks_equal_plain_loops_without_rows_of_pairs(spark, monkeypatch):
    """Blocks of a few scores each give the means of plain loops, and no news is sent once for every target."""
    monkeypatch.setattr(evaluate, "AREA", 60, raising=False)
    draw = np.random.default_rng(5)
    news, targets = draw.integers(-2, 3, (40, 4)) + 0.5, draw.integers(-2, 3, (30, 4)) + 0.5
    cases = [("ab"[src % 2], src, dst) for src in range(4) for dst in range(src, 34, 3)]
    edges = [(n, (n * s) % 5) for n in range(45) for s in range(1, 4)]
    groups, final = evaluate.golden_eval(spark.createDataFrame(cases, "category string, src long, dst long"), spark.createDataFrame(edges, "src long, dst long"), frame_of(spark, news), frame_of(spark, targets), K)
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan
    scores, of = np.round(unit(news) @ unit(targets).T, 9), {}
    for category, src, dst in cases:
        if dst < len(targets):
            ranks = [1 + int((scores[n] > scores[n, dst]).sum()) for n in {n for n, x in edges if x == src and n < len(news)}]
            of.setdefault(category, []).append((np.mean([1 / r for r in ranks]) if ranks else 0, np.mean([r <= K for r in ranks]) if ranks else 0))
    got = {r.category: (r.cases, r.mrr, r.hit) for r in groups.collect()}
    want = {c: (len(v), *np.mean(v, axis=0)) for c, v in [*of.items(), ("all", sum(of.values(), []))]}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)
    assert final.first().score == pytest.approx(np.mean([(m + h) / 2 for c, (_, m, h) in want.items() if c != "all"]), abs=1e-9)
