"""N-gram Jaccard join by universe partition.

A text is its set of word shingles, hashed. Two sets with a Jaccard similarity of at
least p differ in at most H tokens, H following their sizes. For each band of sizes the
universe of tokens is cut by a hash into m segments. If a set counts its segments so
that the counts add up to H + 1 - one for a segment that must agree exactly, two for
one that may differ by one token, none for one that is skipped - then any set that is
similar to it agrees with it in some counted segment (pigeonhole). So sets meet in
buckets keyed by band, segment and the segment's tokens, or the tokens less one.

How many segments there are, and for how many of them the neighbourhoods of one
deletion are indexed, is chosen by band from the expected numbers of keys and of chance
meetings. Empty segments are skipped, and so are the segments of a set's most crowded
buckets, as long as its others still add up. Sets that are equal are one from the start.

Pairs that meet are sifted before any text moves: a set's sketch holds the parity of the
number of its tokens in each of some cells, so two sketches differ in no more cells than
their sets differ in tokens. What differs in too many is not similar, and what remains
is verified on the whole texts. Sets are first compared with leaders of their buckets, in
a few rounds, so that groups are joined by a pair for each member. Then whatever of
different groups still meets is sifted, pair by pair in small buckets and in blocks inside
tasks in large ones, and verified: first the nearest of each set in each other group, then,
among the groups that are left, all the rest.

Shingles are compared by 52-bit hashes. Sets are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textscan
from .tables import stored

#: Largest size of a band over its smallest; standard deviations of the number of empty segments
#: that an allocation allows for, besides their mean.
RATIO, DEVIATIONS = 1.6, 2.33
#: Segments that every set may skip besides empty ones, about; rounds of leaders.
SPARE, LEADERS = 2, 1
#: What a chance meeting costs in keys, and the chance that a token of one set is in another that isn't similar.
PRICE, COMMON = 8.0, 0.25
#: Sets in a bucket up to which its pairs are rows; sets in a block of a larger one; numbers compared at once.
PAIRED, BLOCK, COMPARED = 4, 1024, 1 << 21
#: Buckets of a set that are listed with it.
LISTED = 16
#: Hashes of sets that may belong to two different sets each, at most; of 64 bits, a few among 10 ** 10 sets do.
CLASHES = 10_000
#: Sets that a task remembers so as not to index them twice.
REMEMBERED = 1 << 18
HASH_BITS = 52
#: Bits of the slack in a row's ``info``; above it are one for neighbourhood segments and the band.
SLACK_BITS = 10


class Band(NamedTuple):
    """Sizes low to high; segments, and those of them (the first) whose one-deletion neighbourhoods are indexed."""

    low: int
    high: int
    segments: int
    deletions: int


def _splits(needed: int) -> list[int]:
    """Numbers of neighbourhood segments that are tried: all small ones, then in steps of a quarter."""
    out = [0]
    while out[-1] < needed:
        out.append(out[-1] + max(1, out[-1] // 4))
    return out


def cost(high: int, segments: int, deletions: int) -> float:
    """Keys of a set of ``high`` tokens, and what its chance meetings cost.

    A segment has t tokens on average and is met by chance where all of them are common; of
    a neighbourhood, which has a key for each token and one for all, one token may be rare.
    """
    t = high / segments
    full = 1 - exp(-t)
    keys = segments * full + deletions * t
    met = (segments - deletions) * COMMON**t + deletions * (1 + t) * COMMON ** max(t - 1, 0)
    return keys + PRICE * full * met


def _allocation(high: int, needed: int) -> tuple[int, int]:
    """(segments, deletions) of the least cost among those whose counts still add up when the
    usual number of segments is empty (each with a chance of about exp(-high / segments)).

    Where no allocation leaves SPARE segments to skip, as for the smallest sets, none has to.
    """
    for spare in (SPARE, 0):
        best = None
        for deletions in _splits(needed):
            segments = max(1, deletions, needed + spare - deletions)
            while segments <= 2 * needed + 16:
                chance = exp(-high / segments)
                empty = segments * chance + DEVIATIONS * sqrt(segments * chance * (1 - chance))
                short = needed + spare + round(empty) - segments - deletions
                if short <= 0:
                    found = (cost(high, segments, deletions), segments, deletions)
                    best = min(best, found) if best else found
                    break
                segments += short
        if best:
            return best[1:]
    return needed, 0


@lru_cache(8)
def bands(percent: int) -> list[Band]:
    """Bands up to sizes beyond any text; the last is open."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * RATIO))
        needed = most_apart(high, percent) + 1
        segments, deletions = _allocation(high, needed)
        out.append(Band(low, high, segments if needed > 1 else 0, deletions if needed > 1 else 0))
        low = high + 1
    return out


def most_apart(size: int, percent: int) -> int:
    """Tokens by which a set of the size and a smaller or larger similar one differ at most."""
    return size * (100 - percent) // percent


def shingles(texts: list[bytes], words: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted. A text of fewer words is one shingle, one without words none."""
    hashes, _, which, _ = textscan.words(texts, lower)
    n = len(texts)
    counts = np.bincount(which, minlength=n)
    first = np.cumsum(counts) - counts
    out = np.zeros(len(hashes), np.uint64)
    for i in range(words):
        part = np.zeros(len(hashes), np.uint64)
        part[: max(len(hashes) - i, 0)] = hashes[i:]
        out = textscan.mixed(out * np.uint64(textscan.BASE) + part)
    place = np.arange(len(hashes)) - first[which]
    whole = place <= (counts - words)[which]
    for d in np.flatnonzero((counts > 0) & (counts < words)):
        some = np.uint64(counts[d])
        for h in hashes[first[d] : first[d] + counts[d]]:
            some = textscan.mixed(np.array([some]) * np.uint64(textscan.BASE) + h)[0]
        out[first[d]] = some
        whole[first[d]] = True
    key = np.sort((which[whole].astype(np.uint64) << np.uint64(HASH_BITS)) | (out[whole] >> np.uint64(64 - HASH_BITS)))
    key = key[np.diff(key, prepend=~key[:1]) != 0]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)


def _parts(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Chunks of at most 2 ** (64 - HASH_BITS) texts."""
    most = 1 << (64 - HASH_BITS)
    for first, part in textscan.chunks(texts):
        for i in range(0, len(part), most):
            yield first + i, part[i : i + most]


def set_hashes(doc: np.ndarray, token: np.ndarray, n: int, clashes: list[np.ndarray] = (), bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, hash, other hash) of each set; the hashes of an empty one are 0.

    Each of ``clashes`` lists hashes that belong to several sets; those sets are given new
    ones, made of both hashes. ``bits`` are those that the first hash has.
    """
    size = np.bincount(doc, minlength=n)
    sums = np.zeros((4, n), np.uint64)
    for row, salt in zip(sums, (0, 0x5DEECE66D, 0x2545F4914F6CDD1D, 0xD1342543DE82EF95)):
        np.add.at(row, doc, textscan.mixed(token ^ np.uint64(salt)))
    node, check = (textscan.mixed(sums[i] ^ textscan.mixed(sums[i + 1] + size.astype(np.uint64))) for i in (0, 2))
    node = (node >> np.uint64(64 - bits)).astype(np.int64)
    for turn, listed in enumerate(clashes):
        other = textscan.mixed(node.astype(np.uint64) ^ textscan.mixed(check + np.uint64(turn))).astype(np.int64)
        node = np.where(np.isin(node, listed), other, node)
    return size, np.where(size > 0, node, 0), np.where(size > 0, check.astype(np.int64), 0)


def sketches(doc: np.ndarray, token: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For each set the parities of the numbers of its tokens in cells, packed in 64-bit numbers.

    A set has 2 to 4 cells a token, their number a power of two. Half as many cells follow
    from folding, so sketches of sets of different sizes can be compared.
    """
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    first = np.cumsum(cells) - cells
    place = textscan.mixed(token ^ np.uint64(0xA0761D6478BD642F)).astype(np.int64) & (cells[doc] - 1)
    odd = (np.bincount(first[doc] + place, minlength=int(cells.sum())) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").view(np.int64)
    return np.split(packed, (first // 64)[1:]) if len(size) else []


def most_different(sizes, percent: int):
    """Tokens in just one of two similar sets, at most, from the sum of their sizes; works on numbers and columns of long."""
    if isinstance(sizes, Column):
        return sizes - 2 * F.ceil(percent * sizes / (100 + percent))
    return sizes - 2 * -(-(percent * sizes) // (100 + percent))


def keys(doc: np.ndarray, token: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, info) of every bucket that the sets belong to.

    A set is indexed in its own band and in the lower ones that hold similar smaller sets.
    ``info`` has the band, whether the segment is one of the neighbourhoods, and the slack:
    by how many its counted segments exceed what it needs. A set that lacks some is also
    indexed by its empty segments, where it meets the others that lack some.
    """
    table = bands(percent)
    lows = np.array([b.low for b in table])
    own = np.searchsorted(lows, size, "right") - 1
    lowest = np.searchsorted(lows, np.maximum(-(-size * percent // 100), 1), "right") - 1
    found = []
    for down in range(int((own - lowest).max(initial=0)) + 1):
        for index in np.unique((own - down)[(size > 0) & (own - down >= lowest)]).tolist():
            band = table[index]
            if not band.segments:
                continue
            inside = (size > 0) & (own - down == index) & (index >= lowest)
            member = inside[doc]
            row = (np.cumsum(inside) - 1)[doc[member]]
            t = token[member]
            m = band.segments
            seed = np.uint64((index + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            segment = ((textscan.mixed(t ^ seed) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            cell = row * m + segment
            sets = np.flatnonzero(inside)
            count = np.bincount(cell, minlength=len(sets) * m)
            value = textscan.mixed(t)
            sums = np.zeros(len(sets) * m, np.uint64)
            np.add.at(sums, cell, value)
            grid = count.reshape(-1, m)
            slack = (grid > 0).sum(1) + (grid[:, : band.deletions] > 1).sum(1) - np.array([most_apart(int(s), percent) + 1 for s in size[sets]])
            cells = np.arange(len(sets) * m)
            of, which = cells // m, cells % m
            tag = textscan.mixed(seed + which.astype(np.uint64))
            near = which < band.deletions
            info = (index << (SLACK_BITS + 1)) | (near.astype(np.int64) << SLACK_BITS) | np.clip(slack, 0, (1 << SLACK_BITS) - 1)[of]
            some = count > 0
            key = textscan.mixed(sums ^ tag)
            found.append((sets[of[some]], key[some], info[some]))
            lost = ~some & (slack < 0)[of]
            found.append((sets[of[lost]], textscan.mixed(tag[lost] ^ np.uint64(0xE)), info[lost]))
            if band.deletions:
                less = (segment < band.deletions) & (count[cell] > 1)
                c = cell[less]
                found.append((sets[of[c]], textscan.mixed((sums[c] - value[less]) ^ tag[c]), info[c]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def text_key():
    """A hash of a row's text; with doc_id it names the row."""
    return F.xxhash64("text").alias("text_key")


def row_order():
    """What rows of (doc_id, text_key) are sorted by; null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")


def document_sets(docs: DataFrame, words: int, clashes: list[np.ndarray] = (), bits: int = 64) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, check, sketch) of each text's set; ``text_key`` is a hash of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, part in _parts(batch["text"].fillna("").tolist()):
                doc, token = shingles(part, words)
                size, node, check = set_hashes(doc, token, len(part), clashes, bits)
                rows = batch[["doc_id", "text_key"]].iloc[first : first + len(part)]
                yield rows.assign(n_shingles=size, node=node, check=check, sketch=sketches(doc, token, size))

    keyed = docs.select("doc_id", text_key(), "text")
    return keyed.mapInPandas(run, "doc_id long, text_key long, n_shingles long, node long, check long, sketch array<long>")


def named_sets(docs: DataFrame, words: int, bits: int = 64) -> tuple[DataFrame, list[np.ndarray]]:
    """The sets of all texts, with a ``node`` that no two different sets share, and the hashes replaced for that.

    Hashes of 64 bits clash for a few sets among 10 ** 10. The few that do are listed, which
    has a checked bound, and their sets are named anew until none clash.
    """
    clashes: list[np.ndarray] = []
    while True:
        sets = stored(document_sets(docs, words, clashes, bits), "sets")
        twice = sets.filter("n_shingles > 0").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a < b")
        found = twice.select("node").limit(CLASHES + 1).toPandas()["node"].to_numpy()
        if not len(found):
            return sets.drop("check"), clashes
        if len(found) > CLASHES:
            raise ValueError(f"over {CLASHES} hashes belong to several sets")
        clashes.append(found)


def bucket_rows(docs: DataFrame, words: int, percent: int, clashes: list[np.ndarray] = (), bits: int = 64) -> DataFrame:
    """(key, node, info) for the distinct sets of each task's texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for _, part in _parts(batch["text"].fillna("").tolist()):
                doc, token = shingles(part, words)
                size, node, _ = set_hashes(doc, token, len(part), clashes, bits)
                fresh = np.zeros(len(part), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > REMEMBERED:
                    seen.clear()
                which, key, info = keys(doc, token, np.where(fresh, size, 0), percent) if fresh.all() else keys(doc[fresh[doc]], token[fresh[doc]], np.where(fresh, size, 0), percent)
                for i in range(0, len(key), 1 << 18):
                    some = slice(i, i + (1 << 18))
                    yield pd.DataFrame({"key": key[some].astype(np.int64), "node": node[which[some]], "info": info[some].astype(np.int32)})

    return docs.select("text").mapInPandas(run, "key long, node long, info int")


def similar(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, exactly: 100 * common >= percent * all."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                rows = batch.iloc[i : i + 1024]
                keep = np.zeros(len(rows), bool)
                both = [x for pair in zip(rows["left"], rows["right"]) for x in pair]
                for first, part in _even_parts(both):
                    doc, token = shingles(part, words)
                    size = np.bincount(doc, minlength=len(part))
                    pair = (doc // 2).astype(np.uint64) << np.uint64(HASH_BITS) | token
                    pair.sort()
                    twice = np.bincount((pair[1:][pair[1:] == pair[:-1]] >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(part) // 2)
                    keep[first // 2 : (first + len(part)) // 2] = 100 * twice >= percent * (size[::2] + size[1::2] - twice)
                yield rows.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInPandas(run, "a long, b long")


def _even_parts(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Chunks of whole pairs."""
    part, size, first = [], 0, 0
    for i in range(0, len(texts), 2):
        pair = [texts[i].encode(), texts[i + 1].encode()]
        if part and size > textscan.CHUNK:
            yield first, part
            part, size, first = [], 0, i
        part += pair
        size += len(pair[0]) + len(pair[1])
    if part:
        yield first, part


def sifted(pairs: DataFrame, looks: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart): the pairs that sizes and sketches don't rule out; ``apart`` is in how many cells the sketches differ."""
    left = looks.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    right = looks.select(F.col("node").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("t"))
    near = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")).alias("near")
    met = pairs.join(left, "a").join(right, "b").filter(near)
    few = F.least(F.size("s"), F.size("t"))
    fold = lambda x: F.when(F.size(x) == few, F.col(x)).otherwise(F.zip_with(F.slice(x, 1, few), F.slice(x, few + 1, few), lambda p, q: p.bitwiseXOR(q)))
    apart = F.aggregate(F.zip_with(fold("s"), fold("t"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)
    # Sketches that would have to be folded twice are of similar sets only below 50 %; they rule nothing out.
    apart = F.when(2 * few >= F.greatest(F.size("s"), F.size("t")), apart).otherwise(0)
    return met.withColumn("apart", apart).filter(F.col("apart") <= most_different(F.col("n") + F.col("m"), percent)).select("a", "b", "apart")


def _first_common(left: np.ndarray, right: np.ndarray) -> int | None:
    """The least number of two sorted lists, of which only the first LISTED are given; None where that isn't known."""
    common = np.intersect1d(left, right, assume_unique=True)
    known = [side[-1] for side in (left, right) if len(side) == LISTED]
    return int(common[0]) if len(common) and all(common[0] <= k for k in known) else None


def sifted_in_groups(members: DataFrame, looks: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b, apart) for what sizes and sketches don't rule out among sets of different labels in each bucket (key, node, label).

    With ``nearest``, for each set and other label only the set that is the fewest cells apart.

    A bucket of more than BLOCK sets is dealt to blocks by a hash, and every two of its
    blocks make a group, so that groups stay of two blocks' size whatever the bucket's.
    Sketches travel, no texts. Near copies meet in many buckets: every set brings the first
    LISTED of its buckets, and a pair is a row only in the first one that both have. Where
    that lies beyond what is listed, each bucket has the pair.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("sets"))
    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    dealt = members.join(sizes, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))
    placed = dealt.select("key", "node", "label", "block", F.explode(others).alias("other"))
    team = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("team")
    placed = placed.select(team, "key", "node", "label", "block", (F.col("block") == F.col("other")).alias("own"))
    lists = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LISTED).alias("keys"))
    marked = looks.select("node", "n_shingles", "sketch").join(lists, "node")
    rows = placed.join(marked, "node").repartition("team").sortWithinPartitions("team")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = int(np.searchsorted(batch["team"].to_numpy(), batch["team"].iloc[-1]))
            held = batch.iloc[last:]
            yield from found(batch.iloc[:last])
        if held is not None:
            yield from found(held)

    def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        team, node, label, size, block = (rows[c].to_numpy() for c in ("team", "node", "label", "n_shingles", "block"))
        starts = np.append(np.flatnonzero(np.diff(team, prepend=team[:1] - 1)), len(team)) if len(team) else np.zeros(1, np.int64)
        for a, b in zip(starts, starts[1:]):
            marks = rows["sketch"].iloc[a:b].tolist()
            few = min(len(m) for m in marks)
            table = np.stack([np.bitwise_xor.reduce(np.asarray(m, np.int64).reshape(-1, few), axis=0) for m in marks]).view(np.uint64)
            names, groups, n = node[a:b], label[a:b], size[a:b]
            blocks, own, key, lists = block[a:b], rows["own"].iloc[a], rows["key"].iloc[a], rows["keys"].iloc[a:b].tolist()
            step = max(1, COMPARED // (table.size or 1))
            for i in range(0, b - a, step):
                apart = np.bitwise_count(table[i : i + step, None, :] ^ table[None, :, :]).sum(2, dtype=np.int64)
                both = n[i : i + step, None] + n[None, :]
                near = 100 * np.minimum(n[i : i + step, None], n[None, :]) >= percent * np.maximum(n[i : i + step, None], n[None, :])
                fit = near & (apart <= most_different(both, percent)) & (groups[i : i + step, None] != groups[None, :])
                if not own:  # pairs of one block are found where the block meets itself
                    fit &= blocks[i : i + step, None] != blocks[None, :]
                if not nearest:
                    fit &= names[i : i + step, None] < names[None, :]
                x, y = np.nonzero(fit)
                far = apart[x, y]
                if nearest and len(x):
                    order = np.lexsort((names[y], far, groups[y], x))
                    x, y, far = x[order], y[order], far[order]
                    some = (np.diff(x, prepend=-1) != 0) | (np.diff(groups[y], prepend=groups[y[0]]) != 0)
                    x, y, far = x[some], y[some], far[some]
                first = np.array([_first_common(lists[p], lists[q]) in (None, key) for p, q in zip((i + x).tolist(), y.tolist())], bool)
                x, y, far = x[first], y[first], far[first]
                if len(x):
                    yield pd.DataFrame({"a": np.minimum(names[i + x], names[y]), "b": np.maximum(names[i + x], names[y]), "apart": far})

    return rows.select("team", "key", "node", "label", "block", "own", "n_shingles", "sketch", "keys").mapInPandas(run, "a long, b long, apart long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the least node that links lead to.

    Alternating stars: every node's larger, then smaller neighbours are linked to its least
    one, until nothing changes; the edges never get more, and hubs are summed by partial
    minima.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = stored(after.filter("u > v").distinct(), "edges")


def crowds(docs: DataFrame, words: int, percent: int, clashes: list[np.ndarray] = (), bits: int = 64) -> DataFrame:
    """(key, node): the buckets that hold different sets and that some of their sets need."""
    by_key = W.partitionBy("key")
    rows = bucket_rows(docs, words, percent, clashes, bits)
    shared = rows.withColumns({"least": F.min("node").over(by_key), "most": F.max("node").over(by_key)}).filter("least < most")
    shared = stored(shared.select("key", "node", "info").distinct(), "buckets")
    # A set skips its most crowded buckets as far as its slack goes; a bucket that all its sets skip is not needed.
    sizes = shared.groupBy("key").agg(F.count("*").alias("sets"))
    weight = F.when(F.shiftright("info", SLACK_BITS).bitwiseAND(1) == 1, 2).otherwise(1)
    slack = F.col("info").bitwiseAND((1 << SLACK_BITS) - 1)
    costliest = W.partitionBy("node", F.shiftright("info", SLACK_BITS + 1)).orderBy(F.desc("sets"), "key")
    counted = shared.join(sizes, "key").withColumn("upto", F.sum(weight).over(costliest)).filter(F.col("upto") > slack)
    kept = shared.join(counted.select("key").distinct(), "key", "left_semi").select("key", "node")
    # Near copies share many segments: of buckets with the same sets one is enough.
    alike = kept.groupBy("key").agg(F.count("*").alias("sets"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"sum{i}") for i in range(2)])
    return stored(kept.join(alike.groupBy("sets", "sum0", "sum1").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "kept")


def link_sets(docs: DataFrame, sets: DataFrame, words: int, percent: int, clashes: list[np.ndarray] = (), bits: int = 64) -> DataFrame:
    """(node, label) for every set that is similar to another one: their components."""
    spark = docs.sparkSession
    kept = crowds(docs, words, percent, clashes, bits)
    met = kept.select("node").distinct()
    # A row is named by doc_id and text: ids may be null or repeated with other texts.
    looks = sets.join(met, "node", "left_semi").groupBy("node").agg(F.min(row_order()).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    looks = stored(looks.select("node", F.struct("row.doc_id", "row.text_key").alias("_key"), "n_shingles", "sketch"), "looks")
    said = docs.select(F.struct("doc_id", text_key()).alias("_key"), "text")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = said.join(looks.join(wanted, "node", "left_semi").select("node", "_key"), "_key").select("node", "text").dropDuplicates(["node"])
        return stored(similar(pairs, texts, words, percent), "links")

    links = spark.createDataFrame([], "a long, b long")
    tried, labels = links, spark.createDataFrame([], "node long, label long")
    placed = kept.withColumn("label", F.col("node"))

    def joined(pairs: DataFrame) -> None:
        """Verifies pairs of (a < b) that weren't tried before, and labels sets and buckets anew."""
        nonlocal links, tried, labels, placed
        pairs = stored(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.take(1):
            return
        tried, links = tried.unionByName(pairs), links.unionByName(verified(pairs))
        labels = stored(components(links), "labels")
        now = placed.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # Buckets whose sets are all in one group have nothing left to find.
        mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        placed = stored(now.join(mixed.select("key"), "key", "left_semi").select("key", "node", "label"), "open")

    for turn in range(LEADERS):
        # Every set and the leaders of its buckets: the nearest leader of those that may be similar.
        rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), F.col("node"), F.col("label"))
        first = placed.groupBy("key").agg(F.min(rank).alias("first"))
        pairs = placed.join(first, "key").filter("label <> first.label").select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
        nearest = sifted(pairs, looks, percent).groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x"))
        joined(nearest.select(F.least("x.a", "b").alias("a"), F.greatest("x.a", "b").alias("b")))

    # Sets of different groups that still meet: first the nearest of each set in each other group, then all.
    for nearest in (True, False):
        sizes = placed.groupBy("key").agg(F.count("*").alias("sets"))
        sized = placed.join(sizes, "key")
        few = sized.filter(F.col("sets") <= PAIRED)
        other = few.select("key", F.col("node").alias("b"), F.col("label").alias("other"))
        pairs = few.select("key", F.col("node").alias("a"), "label").join(other, "key").filter("a < b AND label <> other").select("a", "b").distinct()
        many = stored(sized.filter(F.col("sets") > PAIRED).select("key", "node", "label"), "many")
        joined(sifted(pairs, looks, percent).unionByName(sifted_in_groups(many, looks, percent, nearest)))
    return labels


def near_roots(docs: DataFrame, words: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """(doc_id, text_key, n_shingles, root): the size of each text's set and the component it is in, whatever the ids.

    ``root`` is the least hash of the component's sets, and means nothing for empty sets.
    ``bits`` below 64 only make hashes of sets clash more, which changes no component.
    """
    docs = docs.select("doc_id", "text")
    sets, clashes = named_sets(docs, words, bits)
    labels = link_sets(docs, sets, words, percent, clashes, bits)
    placed = sets.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node"))
    return stored(placed.select("doc_id", "text_key", "n_shingles", "root"), "placed")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id): the size of each text's set and the least doc_id that links lead to.

    ``docs`` has doc_id and text. Null texts and texts without words have an empty set and
    are linked with nothing; a text of fewer words than a shingle has one shingle, its whole
    sequence. Rows of the same doc_id are one document each by its own text; a null doc_id
    is never a component_id unless all of a component are null. So
    unrelated components may have the same component_id; ``near_roots`` tells them apart.
    """
    placed = near_roots(docs, words, percent)
    least = placed.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    alone = placed.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.filter("n_shingles > 0").join(least, "root").select("doc_id", "text_key", "n_shingles", F.col("least").alias("component_id")).unionByName(alone)
