"""Embedding evaluation, gating and publishing (2.H). Ranks count strictly higher scores only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cooccurrence, dense_index, hashed
from .retrieval import cosine, in_blocks, top_k_similar, unit_rows

#: Places of targets that one window of a source looks at.
SPAN = 1 << 16


def pair_cosine(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """H1: adds ``score`` to (src, dst): the cosine of their vectors (id, vector)."""
    a, b = left.select(F.col("id").alias("src"), F.col("vector").alias("a")), right.select(F.col("id").alias("dst"), F.col("vector").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", cosine(F.col("a"), F.col("b")).alias("score"))


def explicit_rank_metrics(scores: DataFrame, k: int) -> DataFrame:
    """H2: (type, mrr, hit) of (type, score, label): a positive's rank is 1 + the negatives with a higher score; 0 and 0
    for a type without positives or without negatives.

    Negatives above are counted by distinct score: a window over the sums of scores, not over rows.
    """
    by_score = scores.groupBy("type", "score").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos"))
    above = F.coalesce(F.sum("neg").over(W.partitionBy("type").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = by_score.withColumn("rank", above + 1)
    total = F.when(F.sum("neg") > 0, F.nullif(F.sum("pos"), F.lit(0)))
    return ranked.groupBy("type").agg(
        F.coalesce(F.sum(F.col("pos") / F.col("rank")) / total, F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("pos")).otherwise(0)) / total, F.lit(0.0)).alias("hit"),
    )


def mean_rank_metrics(metrics: DataFrame) -> DataFrame:
    """H2: (mrr, hit): the means over types, each type counting once; 0 without types."""
    return metrics.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("mrr", "hit")])


def ground_truth(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """H3: (src, dst, strength) of pairs that share news."""
    return cooccurrence(left, right, same)


def relation_retrieval(truth: DataFrame, left: DataFrame, right: DataFrame, k: int, same: bool, sources: int | None = 500, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """H4, H5: (per source, averages) of retrieving the positives among all of ``right``.

    At most ``sources`` sources are looked at, those of the least hashes (None: all); this is the operator's own sampling.
    Per source: rank of the best positive, hit, recall and average precision at k.
    """
    truth = truth.select("src", "dst").distinct()
    truth = truth.filter("src <> dst") if same else truth
    if sources is not None:
        truth = truth.join(F.broadcast(truth.select("src").distinct().orderBy(hashed(seed, F.col("src")), "src").limit(sources)), "src", "left_semi")
    known = pair_cosine(truth, left, right).groupBy("src").agg(F.max("score").alias("best"), F.count("*").alias("positives"))
    asked = known.join(left.select(F.col("id").alias("src"), "vector"), "src")
    blocks = block_ranks(asked, right, k, same)
    found = blocks.groupBy("src").agg((F.sum("above") + 1).alias("rank"), F.sum("candidates").alias("candidates"))
    order = W.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst")
    top = blocks.select("src", F.inline("top")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    hits = top.join(truth, ["src", "dst"], "left_semi")
    precision = F.row_number().over(W.partitionBy("src").orderBy("place")) / F.col("place")
    hits = hits.withColumn("precision", precision).groupBy("src").agg(F.count("*").alias("hits"), F.sum("precision").alias("precisions"))
    per = found.join(known, "src").join(hits, "src", "left").na.fill(0, ["hits"]).na.fill(0.0, ["precisions"])
    per = per.select(
        "src", "rank", (F.col("rank") <= k).cast("int").alias("hit"), (F.col("hits") / F.col("positives")).alias("recall"),
        (F.col("precisions") / F.least(F.col("positives"), F.lit(k), F.col("candidates"))).alias("ap"), "positives", "candidates",
    )
    means = per.agg(F.avg(1 / F.col("rank")).alias("mrr"), F.avg("hit").alias("hit"), F.avg("recall").alias("recall"), F.avg("ap").alias("map"), F.count("*").alias("query_count"), F.avg("candidates").alias("candidate_count"), F.avg("positives").alias("avg_positive_count"))
    return per, means


def block_ranks(asked: DataFrame, right: DataFrame, k: int, same: bool, block: int = 2048) -> DataFrame:
    """(src, above, candidates, top) of each source (src, vector, best) and block of ``right``: how many scores
    are above ``best``, and the block's best k as (dst, score). Scores nearer than half of 1e-9 are equal.
    """
    import numpy as np
    import pandas as pd

    left, targets = in_blocks(asked.select("src", "vector", "best"), "src", right.select("id", "vector"), "id", block)

    def ranked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            sim, ids = unit_rows(a["vector"]) @ unit_rows(b["vector"]).T, b["id"].to_numpy()
            for src, best, scores in zip(a["src"], a["best"], sim, strict=True):
                others = np.flatnonzero(ids != src) if same else np.arange(len(ids))
                order = others[np.lexsort((ids[others], -np.round(scores[others], 9)))[:k]]
                top = [{"dst": ids[j], "score": scores[j]} for j in order]
                rows.append((src, int((scores[others] > best + 5e-10).sum()), len(others), top))
        return pd.DataFrame(rows, columns=["src", "above", "candidates", "top"])

    src, dst = asked.schema["src"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    return left.cogroup(targets).applyInPandas(ranked, f"src {src}, above long, candidates long, top array<struct<dst: {dst}, score: double>>")


def diversity(vectors: DataFrame) -> DataFrame:
    """H6: (type, similarity, variance, score): the mean cosine of different vectors, from the sum of unit vectors, and the mean
    variance of the unit vectors by dimension; 0 and 0 for a type of one vector."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    each = vectors.select("type", norm.alias("norm"), F.posexplode("vector").alias("dim", "x")).withColumn("u", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0))
    by_dim = each.groupBy("type", "dim").agg(F.sum("u").alias("s"), F.coalesce(F.var_samp("u"), F.lit(0.0)).alias("v"), F.count("*").alias("n"))
    pairs = F.nullif(F.max("n") * (F.max("n") - 1), F.lit(0))
    similarity = F.coalesce((F.sum(F.col("s") * F.col("s")) - F.max("n")) / pairs, F.lit(0.0))
    return by_dim.groupBy("type").agg(similarity.alias("similarity"), F.avg("v").alias("variance")).withColumn("score", 1 - F.col("similarity"))


def final_score(metrics: DataFrame, relations: list[str]) -> DataFrame:
    """H7: (score, missing) of (relation, mrr, hit): half the means' sum; 0 where a relation is missing."""
    found = metrics.filter(F.col("relation").isin(relations)).agg(F.count_distinct("relation").alias("n"), F.avg("mrr").alias("m"), F.avg("hit").alias("h"))
    whole = F.col("n") == len(relations)
    return found.select(F.when(whole, (F.col("m") + F.col("h")) / 2).otherwise(0.0).alias("score"), (~whole).cast("int").alias("missing"))


def golden_eval(cases: DataFrame, edges: DataFrame, news: DataFrame, targets: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """H8: (by category, final score) of named cases (category, src, dst): ranks of dst among all targets for each news of src.

    The categories have a row 'all' besides: (category, cases, mrr, hit). Cases without news
    count as 0, those whose target has no vector are skipped. The final score is half the sum
    of the means over the categories that occur, or 0 and missing without any.
    """
    known = cases.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    wanted = known.select("src", "dst").distinct()
    linked = edges.select(F.col("dst").alias("src"), F.col("src").alias("news")).distinct().join(wanted.select("src").distinct(), "src", "left_semi")
    asked = linked.groupBy("news").agg(F.collect_list("src").alias("srcs")).join(news.select(F.col("id").alias("news"), "vector"), "news")
    sums = place_sums(asked, wanted, targets, k)
    per = sums.groupBy("src", "dst").agg((F.sum("reciprocal") / F.sum("n")).alias("mrr"), (F.sum("hits") / F.sum("n")).alias("hit"))
    every = known.join(per, ["src", "dst"], "left").select("category", F.coalesce("mrr", F.lit(0.0)).alias("mrr"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
    means = (F.count("*").alias("cases"), F.avg("mrr").alias("mrr"), F.avg("hit").alias("hit"))
    groups = every.groupBy("category").agg(*means)
    whole = every.groupBy(F.lit("all").alias("category")).agg(*means)
    final = groups.agg(F.coalesce((F.avg("mrr") + F.avg("hit")) / 2, F.lit(0.0)).alias("score"), (F.count("*") == 0).cast("int").alias("missing"))
    return groups.unionByName(whole), final


#: Scores of one block of news that a task holds at once.
AREA = 1 << 24


def place_sums(asked: DataFrame, wanted: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(src, dst, reciprocal, hits, n), summed over news: the places of the wanted (src, dst) among all targets (id, vector)
    by their likeness to each of the news (news, srcs, vector) of src. Scores that are equal to nine places are equal.

    A block of news meets all targets in one task, where the targets pass once: the task holds the scores of its block,
    at most about AREA, and sums per pair; no row is made for a pair of news and target.
    """
    import numpy as np
    import pandas as pd

    asked, targets = asked.select("news", "srcs", "vector"), targets.select("id", "vector")
    m, n = asked.count(), targets.count()
    blocks = max(1, -(-m * max(n, 1) // AREA), -(-m // 2048))
    block = F.pmod(F.xxhash64("news"), F.lit(blocks)).cast("int").alias("block")
    src, dst = wanted.schema["src"].dataType.simpleString(), targets.schema["id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("dst"), F.lit(64))
    lists = wanted.groupBy("src", part).agg(F.collect_list("dst").alias("dsts")).select("src", "dsts")
    said = asked.select(block, F.explode("srcs").alias("src")).distinct().join(lists, "src")
    none = lambda kind: F.lit(None).cast(kind)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    # in the order in which a task needs them: what is wanted of a source, the news, the targets
    rows = said.select("block", F.lit(0).alias("kind"), F.array("src").alias("srcs"), "dsts", none("array<double>").alias("vector"))
    rows = rows.unionByName(asked.select(block, F.lit(1).alias("kind"), "srcs", none(f"array<{dst}>").alias("dsts"), F.col("vector").cast("array<double>").alias("vector")))
    rows = rows.unionByName(targets.select(every, F.lit(2).alias("kind"), none(f"array<{src}>").alias("srcs"), F.array("id").alias("dsts"), F.col("vector").cast("array<double>").alias("vector")))

    def told(held):
        """The sums of a block; ``held`` has by kind: lists by source, news, targets as ids and scores."""
        lists, (named, _), (ids, scores) = held
        if not ids:
            return
        place, found = {x: i for i, x in enumerate(np.concatenate(ids).tolist())}, {}
        for i, srcs in enumerate(named):
            row = np.concatenate([s[i] for s in scores])
            order = np.sort(row)
            for x in srcs:
                if x not in found:
                    known = [d for d in lists.get(x, ()) if d in place]
                    found[x] = known, np.array([place[d] for d in known], np.int64), np.zeros((2, len(known))), [0]
                _, at, sums, count = found[x]
                rank = 1 + len(order) - np.searchsorted(order, row[at], side="right")
                sums += 1 / rank, rank <= k
                count[0] += 1
        for x, (known, _, sums, count) in found.items():
            yield pd.DataFrame({"src": [x] * len(known), "dst": known, "reciprocal": sums[0], "hits": sums[1], "n": count[0]})

    def summed(frames):
        now, held = None, None
        for frame in frames:
            for (at, kind), rows in frame.groupby(["block", "kind"]):
                if at != now:
                    yield from told(held) if held else ()
                    now, held = at, ({}, ([], []), ([], []))
                if kind == 0:
                    for x, dsts in zip(rows["srcs"], rows["dsts"], strict=True):
                        held[0].setdefault(x[0], []).extend(dsts.tolist())
                elif kind == 1:
                    held[1][0].extend(x.tolist() for x in rows["srcs"])
                    held[1][1].append(unit_rows(rows["vector"]))
                elif held[1][1]:
                    held[2][0].append([x[0] for x in rows["dsts"]])
                    held[2][1].append(np.round(np.concatenate(held[1][1]) @ unit_rows(rows["vector"]).T, 9))
        yield from told(held) if held else ()

    return rows.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInPandas(summed, f"src {src}, dst {dst}, reciprocal double, hits double, n long")


def negative_targets(truth: DataFrame, targets: DataFrame, seed: int, same: bool) -> DataFrame:
    """(src, dst, negative): for each positive a target that isn't one of its source, by a hash; sources without any are left out.

    Positives whose draws all hit positives of the source get one of its free targets by number.
    """
    truth = truth.select("src", "dst").distinct().persist()
    n = max(targets.count(), 1)
    text = targets.schema["id"].dataType.simpleString() == "string"
    bucket = F.substring("id", 1, 4) if text else F.floor(F.col("id") / 65536)
    ids = dense_index(targets.select("id"), ["id"], bucket).withColumnRenamed("idx", "place")
    tried = truth.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("turn")).withColumn("place", hashed(seed, F.col("src"), F.col("dst"), F.col("turn")) % n)
    drawn = tried.join(ids, "place").select("src", "dst", "turn", F.col("id").alias("negative"))
    drawn = drawn.filter("src <> negative") if same else drawn
    free = drawn.join(truth.select("src", F.col("dst").alias("negative")), ["src", "negative"], "left_anti")
    found = free.groupBy("src", "dst").agg(F.min(F.struct("turn", "negative"))["negative"].alias("negative")).persist()
    return found.unionByName(numbered_negatives(truth.join(found, ["src", "dst"], "left_anti"), truth, ids, seed, same))


def numbered_negatives(left: DataFrame, truth: DataFrame, ids: DataFrame, seed: int, same: bool) -> DataFrame:
    """(src, dst, negative) for the positives ``left``: the free target of its source whose number a hash gives.

    With blocked places b_0 < b_1 < ..., free place r is r + the count of i with b_i - i <= r.
    Places are cut into spans of SPAN, so that a window holds no more of a source than that.
    """
    ids = ids.withColumn("span", F.floor(F.col("place") / SPAN))
    sources = left.select("src").distinct()
    held = truth.join(sources, "src", "left_semi").select("src", F.col("dst").alias("id"))
    held = held.unionByName(sources.select("src", F.col("src").alias("id"))).distinct() if same else held
    held = held.join(ids, "id").select("src", "span", (F.col("place") - F.col("span") * SPAN).alias("at"))
    sizes, taken = ids.groupBy("span").agg(F.count("*").alias("size")), held.groupBy("src", "span").agg(F.count("*").alias("taken"))
    free = sources.crossJoin(F.broadcast(sizes)).join(taken, ["src", "span"], "left").select("src", "span", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("free"))
    by_src = W.partitionBy("src")
    free = free.withColumns({"upto": F.sum("free").over(by_src.orderBy("span")), "all": F.sum("free").over(by_src)}).filter("free > 0")
    drawn = left.join(free, "src").withColumn("nth", hashed(seed, F.col("src"), F.col("dst"), "free") % F.greatest("all", F.lit(1)) - F.col("upto") + F.col("free"))
    drawn = drawn.filter("nth >= 0 AND nth < free").select("src", "span", "dst", F.col("nth").alias("value"), F.lit(1).alias("drawn"))
    by_span = W.partitionBy("src", "span")
    blocked = held.select("src", "span", F.lit(None).cast(drawn.schema["dst"].dataType).alias("dst"), (F.col("at") - F.row_number().over(by_span.orderBy("at")) + 1).alias("value"), F.lit(0).alias("drawn"))
    before = F.sum(1 - F.col("drawn")).over(by_span.orderBy("value", "drawn").rowsBetween(W.unboundedPreceding, 0))
    placed = drawn.unionByName(blocked).withColumn("place", F.col("span") * SPAN + F.col("value") + before).filter("drawn = 1")
    return placed.join(ids.select("place", "id"), "place").select("src", "dst", F.col("id").alias("negative"))


def separation(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """H9: means of the scores of both, and their difference."""
    p, n = positives.agg(F.avg("score").alias("positive")), negatives.agg(F.avg("score").alias("random"))
    return p.crossJoin(n).withColumn("separation", F.col("positive") - F.col("random"))


def compare_methods(methods: dict[str, dict[str, DataFrame]], relations: dict[str, tuple], k: int, prefix: str = "holdout") -> DataFrame:
    """(name, value): H9 and H4 of every method and relation, and each method's averages over its relations.

    ``methods`` gives by name the vectors (id, vector) of each entity type; ``relations`` by name
    (source type, target type, truth, negatives as of H11). A method without vectors of a type skips the relation;
    so do relations without positives, negatives or sources. Names are method_prefix_relation_metric; an average of nothing is 0.
    """
    found = None
    for method, vectors in methods.items():
        for relation, (source, target, truth, negatives) in relations.items():
            if source not in vectors or target not in vectors:
                continue
            left, right = vectors[source], vectors[target]
            pairs = truth.select("src", "dst").distinct()
            means = relation_retrieval(pairs, left, right, k, source == target, None)[1].select("mrr", "hit", "recall", "map", F.col("query_count").cast("double").alias("query_count"))
            score = lambda edges, mean, n: pair_cosine(edges, left, right).agg(F.avg("score").alias(mean), F.count("*").cast("double").alias(n))  # noqa: E731, B023
            drawn = score(negatives.select("src", F.col("negative").alias("dst")), "random_sim", "random_pair_count")
            row = means.crossJoin(score(pairs, "positive_sim", "positive_pair_count")).crossJoin(drawn)
            row = row.filter("query_count > 0 AND positive_pair_count > 0 AND random_pair_count > 0")
            row = row.select(F.lit(method).alias("method"), F.lit(relation).alias("relation"), (F.col("positive_sim") - F.col("random_sim")).alias("separation"), "*")
            found = row if found is None else found.unionByName(row)
    every = SparkSession.active().createDataFrame([(m,) for m in methods], "method string")
    if found is None:
        found = every.limit(0).selectExpr("method", "method AS relation", *(f"0D AS {c}" for c in METRICS))
    named = {"hit": f"hit_at_{k}", "recall": f"recall_at_{k}", "map": f"map_at_{k}"}
    single = found.select("method", F.concat("relation", F.lit("_")).alias("of"), F.inline(F.array(*[F.struct(F.lit(named.get(c, c)).alias("metric"), F.col(c).alias("value")) for c in METRICS])))
    averages = every.join(found.groupBy("method").agg(*[F.avg(c).alias(c) for c in AVERAGED]), "method", "left")
    overall = averages.select("method", F.lit("").alias("of"), F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.coalesce(c, F.lit(0.0)).alias("value")) for c, name in AVERAGED.items()])))
    return single.unionByName(overall).select(F.concat("method", F.lit(f"_{prefix}_"), "of", "metric").alias("name"), "value")


METRICS = ("positive_sim", "random_sim", "separation", "mrr", "hit", "recall", "map", "query_count", "positive_pair_count", "random_pair_count")
AVERAGED = {"separation": "avg_separation", "hit": "avg_hit_at_k", "mrr": "avg_mrr"}


def gold_similarity(cases: DataFrame, names: dict[str, DataFrame], vectors: dict[str, DataFrame], edges: dict[str, DataFrame] | None = None, k: int = 10, least: int = 3) -> DataFrame:
    """(direction, name, found, rank, other, score): the k entities most like each named one, of both types.

    ``cases`` are (source_type, source_name, target_type, target_name) of keywords and stocks, ``names`` (id, name),
    ``edges`` (src, dst) from news to entities. Across types the best 5k are drawn and those kept that share ``least``
    news with the entity; without edges of either type all stay. Within a type the entity itself is left out.
    Unknown names, and those without partners, have one row without ``other``.
    """
    side = lambda which: cases.select(F.col(f"{which}_type").alias("type"), F.col(f"{which}_name").alias("name"))
    gold = side("source").unionByName(side("target")).filter("name <> ''").distinct()
    joint = edges is not None and not any(e.isEmpty() for e in edges.values())
    out = None
    for kind in ("keyword", "stock"):
        mine = gold.filter(F.col("type") == kind).join(names[kind].select("id", "name"), "name", "left").select("name", F.col("id").alias("query"))
        asked = vectors[kind].join(mine.select(F.col("query").alias("id")).distinct(), "id", "left_semi")
        for other in ("stock", "keyword") if kind == "keyword" else ("keyword", "stock"):
            same = kind == other
            top = top_k_similar(asked, vectors[other], k if same else 5 * k, same=same)
            if joint and not same:
                own = edges[kind].join(asked.select(F.col("id").alias("dst")), "dst", "left_semi")
                shared = cooccurrence(own, edges[other], False).filter(F.col("strength") >= least)
                top = top.join(shared.select(F.col("src").alias("query"), F.col("dst").alias("id")), ["query", "id"], "left_semi")
                place = W.partitionBy("query").orderBy("rank")
                top = top.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            called = top.join(names[other].select("id", F.col("name").alias("other")), "id", "left").withColumn("other", F.coalesce("other", F.col("id").cast("string")))
            rows = mine.join(called, "query", "left").select(F.lit(f"{kind}2{other}").alias("direction"), "name", F.col("query").isNotNull().alias("found"), "rank", "other", F.col("similarity").alias("score"))
            out = rows if out is None else out.unionByName(rows)
    return out


def gold_report(rows: DataFrame) -> DataFrame:
    """(direction, name, line): a line of text for each named entity of ``gold_similarity``."""
    item = F.format_string("%s (%.4f)", "other", "score")
    listed = F.sort_array(F.collect_list(F.when(F.col("other").isNotNull(), F.struct("rank", item.alias("text")))))
    lines = rows.groupBy("direction", "name", "found").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("items"))
    return lines.select("direction", "name", F.concat(F.lit("- "), "name", F.lit(": "), F.when(F.col("found"), F.col("items")).otherwise("NOT_FOUND")).alias("line"))


def metric_delta(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """After - before of (name, value), for named metrics that both have."""
    b = before.filter(F.col("name").isin(names)).select("name", F.col("value").alias("b"))
    return after.join(b, "name").select("name", (F.col("value") - F.col("b")).alias("delta"))


def core_metrics(metrics: DataFrame, prefixes: list[str], suffixes: list[str]) -> DataFrame:
    """Metrics whose name has one of the prefixes and one of the endings."""
    return metrics.filter(F.col("name").rlike(f"^(?:{'|'.join(prefixes)})") & F.col("name").rlike(f"(?:{'|'.join(suffixes)})$"))


def best_epoch(history: DataFrame, highest: bool = True) -> DataFrame:
    """(epoch, metric): the best value, its first epoch; the last epoch where no value is known."""
    value = F.col("metric") if highest else -F.col("metric")
    known = F.max(F.struct(F.col("metric").isNotNull().alias("known"), value.alias("v"), F.when(F.col("metric").isNotNull(), -F.col("epoch")).otherwise(F.col("epoch")).alias("e"), "epoch", "metric"))
    return history.agg(known.alias("x")).select("x.epoch", "x.metric")


def gate(runs: DataFrame, threshold: float = 0.23) -> DataFrame:
    """Adds ``candidate``: nothing missing and the score above the threshold."""
    return runs.withColumn("candidate", (F.col("missing") == 0) & (F.col("score") > threshold))


def news_evidence(news_keyword: DataFrame, news_stock: DataFrame) -> DataFrame:
    """(src_type, src, dst_type, dst, strength): in how many news two entities occur, for both
    directions of every pair of keywords and stocks but an entity with itself. Repeated rows count once.

    Pairs are made once, the smaller one first, and mirrored after they are counted.
    """
    entity = lambda frame, kind, column: frame.select("news_id", F.struct(F.lit(kind).alias("type"), F.col(column).cast("string").alias("id")).alias("x"))
    rows = entity(news_keyword, "keyword", "keyword").unionByName(entity(news_stock, "stock", "stock_id")).distinct()
    pairs = rows.join(rows.withColumnRenamed("x", "y"), "news_id").filter("x < y").groupBy("x", "y").agg(F.count("*").alias("strength"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "strength"))
    return both.select(F.col("x.type").alias("src_type"), F.col("x.id").alias("src"), F.col("y.type").alias("dst_type"), F.col("y.id").alias("dst"), "strength")


def rerank_with_evidence(scores: DataFrame, evidence: DataFrame, alpha: float = 0.2, k: int = 10) -> DataFrame:
    """(src, dst, score, rank): the best of score + alpha * strength."""
    total = F.col("score") + alpha * F.coalesce("strength", F.lit(0))
    rows = scores.join(evidence, ["src", "dst"], "left").select("src", "dst", total.alias("score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst"))).filter(F.col("rank") <= k)


def select_run(runs: DataFrame, status: str, version: str | None = None) -> DataFrame:
    """The newest finished run with the tag (and version) that has both artifacts."""
    held = runs.filter((F.col("state") == "FINISHED") & (F.col("status") == status) & F.col("has_model") & F.col("has_map"))
    held = held.filter(F.col("version") == version) if version else held
    return held.groupBy().agg(F.max(F.struct("start_time", "run_id"))["run_id"].alias("run_id")).filter("run_id IS NOT NULL")


def publish_embeddings(vectors: DataFrame, names: DataFrame, kind: str, version: str) -> DataFrame:
    """Rows (entity_id, entity_type, display_name, gnn_embedding, model_version); indices without an id are dropped, the id stands for a missing name except for news."""
    name = F.col("name") if kind == "news" else F.coalesce("name", "id")
    return vectors.join(names, "idx").select(F.col("id").alias("entity_id"), F.lit(kind).alias("entity_type"), name.alias("display_name"), F.col("vector").alias("gnn_embedding"), F.lit(version).alias("model_version"))


def promote_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run becomes product; other products become legacy and name it."""
    chosen, product = F.col("run_id") == run_id, F.col("status") == "product"
    return runs.withColumns({"status": F.when(chosen, "product").when(product, "legacy").otherwise(F.col("status")), "replaced_by": F.when(product & ~chosen, run_id)})
