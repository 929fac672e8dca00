"""The article graph (2.G): nodes, edges, filters, splits, co-occurrence.

Edges are (src, dst) with the news as src. Random choices follow a hash of a seed and the
row, so they don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hashed(*parts) -> Column:
    """A number from 0 to 2 ** 60 that follows the parts alone."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def keyword_nodes(snapshot: DataFrame, keywords: DataFrame) -> DataFrame:
    """G1: keywords of the snapshot that have an id."""
    return snapshot.join(keywords, snapshot["keyword"] == keywords["word"]).select("keyword_id", "word", "vector")


def stock_nodes(snapshot: DataFrame, stocks: DataFrame) -> DataFrame:
    """All stocks of the snapshot; the id stands for a missing name."""
    return snapshot.join(stocks, "stock_id", "left").select("stock_id", F.coalesce("stock_name", F.col("stock_id").cast("string")).alias("stock_name"), "vector")


def news_nodes(refined: DataFrame, target_date: str) -> DataFrame:
    """News up to midnight of the date."""
    return refined.filter(F.col("pub_date") <= F.lit(target_date).cast("timestamp_ntz"))


def restrict_edges(edges: DataFrame, news: DataFrame) -> DataFrame:
    """Edges of these news."""
    return edges.join(news.select("news_id"), "news_id", "left_semi")


def dense_index(nodes: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Adds ``idx`` from 0 in the given order.

    ``bucket`` must rise with the order. Rows are numbered in their bucket and shifted by
    the counts of the buckets before, so only one row per bucket meets in one task.
    """
    rows = nodes.withColumn("_bucket", bucket)
    before = F.coalesce(F.sum("n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = rows.groupBy("_bucket").agg(F.count("*").alias("n")).select("_bucket", before.alias("_shift"))
    numbered = rows.withColumn("_nth", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)))
    return numbered.join(shifts, "_bucket").withColumn("idx", F.col("_nth") - 1 + F.col("_shift")).drop("_bucket", "_nth", "_shift")


def index_edges(edges: DataFrame, news: DataFrame, others: DataFrame, other: str) -> DataFrame:
    """(src, dst) by index; edges of unknown nodes are dropped, repeated ones stay."""
    left = news.select("news_id", F.col("idx").alias("src"))
    right = others.select(other, F.col("idx").alias("dst"))
    return edges.join(left, "news_id").join(right, other).select("src", "dst")


def pub_seconds(news: DataFrame) -> DataFrame:
    """Publication as seconds of 1970."""
    return news.withColumn("pub_ts", F.unix_seconds(F.col("pub_date").cast("timestamp")))


def filter_low_degree(edges: DataFrame, least: int, degree_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, mapping): nodes ``dst`` with enough edges get a new dense ``new_idx``; other edges go."""
    degrees = (edges if degree_edges is None else degree_edges).groupBy("dst").agg(F.count("*").alias("degree")).filter(F.col("degree") >= least)
    mapping = dense_index(degrees.select("dst"), ["dst"], F.floor(F.col("dst") / 65536)).withColumnRenamed("idx", "new_idx")
    return edges.join(mapping, "dst").select("src", F.col("new_idx").alias("dst")), mapping


def drop_isolated_news(news: DataFrame, *edges: DataFrame) -> DataFrame:
    """News with an edge of any kind, with a new dense ``new_idx``."""
    linked = edges[0].select("src")
    for e in edges[1:]:
        linked = linked.unionByName(e.select("src"))
    kept = news.join(linked.distinct(), news["idx"] == linked["src"], "left_semi")
    return dense_index(kept.withColumnRenamed("idx", "old_idx"), ["old_idx"], F.floor(F.col("old_idx") / 65536)).withColumnRenamed("idx", "new_idx")


#: Entities of one article that meet each other in one task.
SPAN = 1024


def shared_news(left: DataFrame, right: DataFrame, same: bool = False, span: int = SPAN) -> DataFrame:
    """(src, dst), once for each of the news that two nodes share; ``left`` (news, src) and ``right`` (news, dst) are distinct.
    A news may be named by several columns. Where both sides are dealt out by one of them already, nothing is dealt out anew.

    Of one type (``same``) each pair comes once, src being the smaller. News of up to ``span`` nodes a side meet under the news.
    """
    by = [c for c in left.columns if c != "src"]
    sized = lambda rows, name: rows.withColumn(name, F.count("*").over(W.partitionBy(*by)))
    left, right = sized(left, "n_left"), sized(right, "n_right")
    # the further names are compared as ranges: a join by all of them would deal both sides out anew
    other = right.filter(F.col("n_right") <= span).withColumnsRenamed({c: f"{c}_right" for c in by[1:]})
    few = left.filter(F.col("n_left") <= span).join(other, by[0])
    for c in by[1:]:
        few = few.filter(F.col(c).between(F.col(f"{c}_right"), F.col(f"{c}_right")))
    few = few.select("src", "dst")
    many = left.filter(F.col("n_left") > span).select(by).unionByName(right.filter(F.col("n_right") > span).select(by)).distinct()
    many = F.broadcast(many)  # at most one for every ``span`` rows
    hot = _met_in_blocks(left.join(many, by), right.join(many, by), by, same, span)
    return (few.filter("src < dst") if same else few).unionByName(hot)


def _met_in_blocks(left: DataFrame, right: DataFrame, by: list[str], same: bool, span: int) -> DataFrame:
    """(src, dst) of news with many nodes, whose numbers are n_left and n_right, cut into blocks by a hash of the node.

    Every two blocks of a news meet under a key of their own, blocks of one type in a triangle, so no key has more than
    about ``span`` rows a side, and a row is sent once for each block of the other side.
    """
    of = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    blocks = lambda n: F.ceil(F.col(n) / span).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if same:
        dealt = lambda rows, c, n: rows.select(*by, c, of(c, blocks(n)).alias("own"), upto(blocks(n)).alias("other"))
        low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
        a, b = dealt(left, "src", "n_left").select(*by, low, high, "own", "src"), dealt(right, "dst", "n_right").select(*by, low, high, F.col("own").alias("to"), "dst")
        return a.join(b, [*by, "low", "high"]).filter("src < dst AND (own <> to OR low = high)").select("src", "dst")
    sizes = left.select(*by, "n_left").distinct().join(right.select(*by, "n_right").distinct(), by)
    a = left.drop("n_left").join(sizes, by).select(*by, "src", of("src", blocks("n_left")).alias("i"), upto(blocks("n_right")).alias("j"))
    b = right.drop("n_right").join(sizes, by).select(*by, "dst", of("dst", blocks("n_right")).alias("j"), upto(blocks("n_left")).alias("i"))
    return a.join(b, [*by, "i", "j"]).select("src", "dst")


def strengths(left: DataFrame, right: DataFrame, same: bool = False) -> DataFrame:
    """(src, dst, strength): in how many news two nodes of ``shared_news`` meet."""
    return shared_news(left, right, same).groupBy("src", "dst").agg(F.count("*").alias("strength"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs of one type and the same the other way round."""
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength"))


def pmi_edges(keyword_edges: DataFrame, stock_edges: DataFrame, n_news: int, min_pmi: float, min_cooccur: int) -> DataFrame:
    """(keyword, stock, joint, pmi) of pairs that share enough news and do so more than by chance.

    Each edge counts once. Pairs are counted before they leave a task, and frequencies
    join as one row per node.
    """
    k, s = keyword_edges.select(F.col("src").alias("news"), F.col("dst").alias("src")).distinct(), stock_edges.select(F.col("src").alias("news"), "dst").distinct()
    joint = shared_news(k, s).groupBy(F.col("src").alias("keyword"), F.col("dst").alias("stock")).agg(F.count("*").alias("joint")).filter(F.col("joint") >= min_cooccur)
    fk, fs = k.groupBy(F.col("src").alias("keyword")).agg(F.count("*").alias("f_k")), s.groupBy(F.col("dst").alias("stock")).agg(F.count("*").alias("f_s"))
    pmi = F.log(F.col("joint") * F.lit(float(n_news)) / (F.col("f_k") * F.col("f_s") + F.lit(1e-8)))
    return joint.join(fk, "keyword").join(fs, "stock").withColumn("pmi", pmi).filter(F.col("pmi") > min_pmi).select("keyword", "stock", "joint", "pmi")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """G11."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def to_undirected(edges: DataFrame) -> DataFrame:
    """Both directions, once."""
    return edges.unionByName(reverse_edges(edges)).distinct()


def ratio_bounds(times: DataFrame, val: float, test: float) -> tuple[int, int]:
    """The last moments of train and validation by ratio, at exact places of the sorted times."""
    if not (0 <= val and 0 <= test and val + test < 1):
        raise ValueError("ratios must be at least 0 and below 1 together")
    n = times.count()
    if not n:
        raise ValueError("no times")
    first = max(0, min(n - 1, int((1 - val - test) * n) - 1))
    second = max(first, min(n - 1, int((1 - test) * n) - 1))
    numbered = dense_index(times.select("pub_ts"), ["pub_ts"], F.floor(F.col("pub_ts") / 86400))
    found = {r["idx"]: r["pub_ts"] for r in numbered.filter(F.col("idx").isin(first, second)).collect()}
    return found[first], found[second]


def date_bounds(train_end: str, val_end: str) -> tuple[Column, Column]:
    """The last seconds of two days."""
    if train_end >= val_end:
        raise ValueError("train must end before validation does")
    return tuple(F.unix_seconds(F.lit(f"{d} 23:59:59").cast("timestamp_ntz").cast("timestamp")) for d in (train_end, val_end))


def temporal_split(edges: DataFrame, times: DataFrame, train_end, val_end) -> DataFrame:
    """Adds ``split`` by the news' time: train, val or test."""
    t1, t2 = (x if isinstance(x, Column) else F.lit(x) for x in (train_end, val_end))
    split = F.when(F.col("pub_ts") <= t1, "train").when(F.col("pub_ts") <= t2, "val").otherwise("test")
    return edges.join(times.select(F.col("idx").alias("src"), "pub_ts"), "src").withColumn("split", split).select("src", "dst", "split")


def message_edges(split: DataFrame, stage: str, policy: str = "train_only", online: bool = False) -> DataFrame:
    """Edges that messages pass on while a split is predicted.

    Policy 'full_graph' passes on all; else those of train. Online, a split has what came before it too.
    """
    if policy == "full_graph":
        return split.select("src", "dst")
    seen = {"train": ["train"], "val": ["train", "val"], "test": ["train", "val", "test"]}[stage] if online else ["train"]
    return split.filter(F.col("split").isin(seen)).select("src", "dst")


def random_split(edges: DataFrame, val: float, test: float, seed: int) -> DataFrame:
    """Adds ``split`` by a hash of the edge."""
    share = hashed(seed, F.col("src"), F.col("dst")) / float(1 << 60)
    return edges.withColumn("split", F.when(share < test, "test").when(share < test + val, "val").otherwise("train"))


def random_link_split(edges: DataFrame, num_src: int, num_dst: int, val: float, test: float, seed: int, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
    """(src, dst, split, label): the edges by random split with label 1, and as many distinct pairs that are no edges with label 0.

    Negatives follow hashed draws in their order, those of train first, then of validation, then of test, from at most
    max(20 times the edges, 1000) draws, so a nearly full graph may give fewer. ``keep`` stores a frame that is read again.
    """
    split = random_split(edges.select("src", "dst"), val, test, seed)
    n = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    train, both = n.get("train", 0), n.get("train", 0) + n.get("val", 0)
    total = both + n.get("test", 0)
    if not total:
        return split.withColumn("label", F.lit(1))
    made, (last, learned, _) = first_negatives(edges, num_src, num_dst, seed, train, both, total, keep=keep)
    of = F.when(F.col("id") < last, "train").when(F.col("id") < learned, "val").otherwise("test")
    return split.withColumn("label", F.lit(1)).unionByName(made.select("src", "dst", of.alias("split"), F.lit(0).alias("label")))


def _free_draws(positives: DataFrame, num_src: int, num_dst: int, draws: int, seed: int) -> DataFrame:
    """(src, dst, id): drawn pairs that aren't positive, each at its first of so many draws."""
    rows = positives.sparkSession.range(draws).select("id", (hashed(seed, "s", F.col("id")) % num_src).alias("src"), (hashed(seed, "d", F.col("id")) % num_dst).alias("dst"))
    return rows.groupBy("src", "dst").agg(F.min("id").alias("id")).join(positives.select("src", "dst"), ["src", "dst"], "left_anti")


def first_negatives(positives: DataFrame, num_src: int, num_dst: int, seed: int, *places: int, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> tuple[DataFrame, list[int]]:
    """(src, dst, id) of the first distinct pairs that aren't positive, as many as the last of ``places`` says, from at most
    max(20 times that, 1000) draws; and for each place the draw behind that many of them.

    Draws are made until there are enough: the first pairs of more draws are the same. They are counted by spans of draws;
    only the spans that hold a place are numbered. ``keep`` stores the pairs, which are counted and read.
    """
    count = places[-1]
    most = max(20 * count, 1000)
    draws = min(most, count + count // 16 + 1000)
    while True:
        free = keep(_free_draws(positives, num_src, num_dst, draws, seed))
        spans = free.groupBy(F.floor(F.col("id") / DRAWS).alias("span")).agg(F.count("*").alias("n"))
        upto = spans.select("span", (F.sum("n").over(W.orderBy("span")) - F.col("n")).alias("before"), "n")
        held = F.filter(F.array(*map(F.lit, sorted({*places}))), lambda x: (x > F.col("before")) & (x <= F.col("before") + F.col("n")))
        found = upto.select("span", "before", F.explode(held).alias("place")).collect()
        if draws == most or any(r.place == count for r in found) or not count:
            break
        draws = min(most, 2 * draws)
    ends = {0: 0}
    for r in found:
        ids = free.filter((F.col("id") >= r.span * DRAWS) & (F.col("id") < (r.span + 1) * DRAWS)).select("id").orderBy("id").limit(r.place - r.before)
        ends[r.place] = ids.agg(F.max("id")).first()[0] + 1
    cuts = [ends.get(x, draws) for x in places]
    return free.filter(F.col("id") < cuts[-1]), cuts


#: Draws that are counted together; at most so many of a place's are numbered.
DRAWS = 1 << 16


def negative_edges(positives: DataFrame, num_src: int, num_dst: int, count: int, seed: int, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
    """Up to ``count`` distinct pairs that aren't positive, from at most max(20 count, 1000) draws."""
    return first_negatives(positives, num_src, num_dst, seed, count, keep=keep)[0].select("src", "dst")


def edge_labels(positives: DataFrame, every: DataFrame, num_src: int, num_dst: int, ratio: float, seed: int, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> DataFrame:
    """Positives with label 1, and ``ratio`` times as many negatives with label 0."""
    made = negative_edges(every, num_src, num_dst, round(positives.count() * ratio), seed, keep)
    return positives.select("src", "dst", F.lit(1).alias("label")).unionByName(made.withColumn("label", F.lit(0)))


def cooccurrence(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """(src, dst, strength): ordered pairs of nodes that share news, and how many; no pair with itself.

    Pairs of one type are counted once and mirrored.
    """
    a = left.select(F.col("src").alias("news"), F.col("dst").alias("src")).distinct()
    b = right.select(F.col("src").alias("news"), "dst").distinct()
    counted = strengths(a, b, same)
    return both_ways(counted) if same else counted


def relation_pairs(keyword_edges: DataFrame, stock_edges: DataFrame, least: int) -> DataFrame:
    """(relation, src, dst, strength) of keyword-stock, stock-stock and keyword-keyword pairs."""
    parts = (("key2stock", keyword_edges, stock_edges, False), ("stock2stock", stock_edges, stock_edges, True), ("key2key", keyword_edges, keyword_edges, True))
    out = None
    for name, left, right, same in parts:
        pairs = cooccurrence(left, right, same).filter(F.col("strength") >= least).select(F.lit(name).alias("relation"), "src", "dst", "strength")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def serving_map(mapping: DataFrame, nodes: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    """(type, id, idx, name) of the nodes that are left, by their new index."""
    return mapping.join(nodes, mapping["dst"] == nodes["idx"]).select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("id"), F.col("new_idx").alias("idx"), F.col(name).cast("string").alias("name"))


def edge_strength(edges: DataFrame, mode: str = "log1p", least: int = 1) -> DataFrame:
    """Adds ``strength``, the edges of dst, and ``weight`` by it."""
    degrees = edges.groupBy("dst").agg(F.count("*").alias("strength")).filter(F.col("strength") >= least)
    s = F.col("strength").cast("double")
    weight = {"log1p": F.log1p(s), "sqrt": F.sqrt(s), "linear": s, "binary": (s > 1).cast("double")}[mode]
    return edges.join(degrees, "dst").select("src", "dst", "strength", weight.alias("weight"))


def prepare_training_graph(news: DataFrame, keyword_edges: DataFrame, stock_edges: DataFrame, val: float, test: float, least: int, min_pmi: float, min_cooccur: int, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> dict[str, DataFrame]:
    """G22, temporal order: bounds, nodes often seen in train, news with edges, PMI of train, splits of both edge types.

    ``news`` has idx and pub_ts. ``keep`` stores a frame that several steps read, such as by a checkpoint.
    """
    t1, t2 = ratio_bounds(news, val, test)
    train = lambda e: temporal_split(e, news, t1, t2).filter("split = 'train'").select("src", "dst")
    k, k_map = filter_low_degree(keyword_edges, least, train(keyword_edges))
    s, s_map = filter_low_degree(stock_edges, least, train(stock_edges))
    k, s, k_map, s_map = (keep(frame) for frame in (k, s, k_map, s_map))
    kept = keep(drop_isolated_news(news, k, s))
    moved = kept.select(F.col("old_idx").alias("src"), "new_idx")
    again = lambda e: e.join(moved, "src").select(F.col("new_idx").alias("src"), "dst")
    k, s = again(k), again(s)
    times = kept.select(F.col("new_idx").alias("idx"), "pub_ts")
    splits = temporal_split(k, times, t1, t2).withColumn("type", F.lit("keyword")).unionByName(temporal_split(s, times, t1, t2).withColumn("type", F.lit("stock")))
    splits = keep(splits)
    in_train = splits.filter("split = 'train'")
    related = pmi_edges(in_train.filter("type = 'keyword'"), in_train.filter("type = 'stock'"), kept.count(), min_pmi, min_cooccur)
    return {"news": kept, "keywords": k_map, "stocks": s_map, "edges": splits, "related": related}
