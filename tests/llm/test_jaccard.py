import random
import re

import numpy as np
import pytest

from millrace.llm import jaccard


def sets_of(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if len(found) >= words else frozenset([tuple(found)])


def brute(rows, words, percent):
    """Component of each row by comparing all pairs."""
    sets = [sets_of(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def changed(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    rows = []
    for n in (1, 2, 3, 4, 5, 7, 9, 12, 15, 21, 33, 60, 110, 260, 700):
        for _ in range(2):
            base = rng.choices(vocabulary, k=n)
            rows.append(base)
            for share in (0, 0, 0.004, 0.01, 0.02, 0.03):
                rows.append(changed(rng, base, share))
            for cut in (1, 2, n // 12, n // 25):
                rows.append(base[: max(1, n - cut)])
            rows.append(passage + base)
    family = rng.choices(vocabulary, k=150)
    for _ in range(60):
        rows.append(changed(rng, family, 0.012))
    step = rng.choices(vocabulary, k=80)
    for i in range(25):  # a chain: neighbours are similar, ends are not
        step = step[1:] + [f"n{i}"]
        rows.append(step)
    rng.shuffle(rows)
    texts = [" ".join(r).replace("w1", "W1") for r in rows] + [None, "", " \t\n", "same", "SAME", "same"]
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, words, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = sorted(tuple(r) for r in jaccard.near_groups(docs, words, percent).drop("text_key").collect())
    want = brute(rows, words, percent)
    # Null, empty and blank texts are linked with nothing.
    assert got == want


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_always_meet(percent):
    """Whatever two similar sets are, they share a bucket that neither of them skips."""
    rng = np.random.default_rng(percent)
    met = 0
    for trial in range(400):
        n = int(rng.choice([2, 3, 5, 8, 9, 10, 11, 19, 20, 33, 60, 150, 400]))
        a = rng.integers(0, 1 << 52, n).astype(np.uint64)
        most = jaccard.most_apart(n, percent)
        drop, add = rng.integers(0, most + 1), rng.integers(0, most + 1)
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 52, add).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < percent * (len(a) + len(b) - common) or len(a) == len(b) == common:
            continue
        doc = np.repeat([0, 1], [len(a), len(b)])
        which, key, info = jaccard.keys(doc, np.concatenate([a, b]), np.array([len(a), len(b)]), percent)
        sides = [{(int(k)) for w, k in zip(which, key) if w == s} for s in (0, 1)]
        assert sides[0] & sides[1], (trial, len(a), len(b), common)
        met += 1
    assert met > 50


def test_crowded_buckets_may_be_left_by_sets_with_slack():
    """A set may skip as many segments as its slack says, whichever they are, and still meets a similar set."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = 300
        a = np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64))
        most = jaccard.most_apart(n, 90)
        cut = rng.integers(0, most // 2 + 1)
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 52, most // 2 - cut).astype(np.uint64)]))
        doc = np.repeat([0, 1], [len(a), len(b)])
        which, key, info = jaccard.keys(doc, np.concatenate([a, b]), np.array([len(a), len(b)]), 90)
        sides = [{int(k): int(i) for w, k, i in zip(which, key, info) if w == s} for s in (0, 1)]
        shared = set(sides[0]) & set(sides[1])
        for band in {sides[0][k] >> (jaccard.SLACK_BITS + 1) for k in shared}:
            here = [k for k in shared if sides[0][k] >> (jaccard.SLACK_BITS + 1) == band]
            slack = sides[0][here[0]] & ((1 << jaccard.SLACK_BITS) - 1)
            assert len(here) > slack


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (9, None), (None, None), (8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.near_groups(docs, 5, 80).drop("text_key").collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 2, 2), (9, 0, 9), (None, 0, None), (8, 1, 8)], key=str)
    assert jaccard.near_groups(docs.limit(0)).count() == 0


def test_one_very_long_text(spark):
    rng = random.Random(5)
    long = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(changed(rng, long, 0.002))), (3, " ".join(changed(rng, long, 0.2)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_groups(docs, 5, 80).collect()} == {1: 1, 2: 1, 3: 3}


def test_components_of_hubs_chains_and_rings(spark):
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 170)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 171)}, 200: 200, 201: 200, 202: 200}


def test_null_and_repeated_ids_keep_their_own_texts(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join(base[1:])), (None, " ".join(other)), (4, " ".join(other[1:])), (4, "far from all of the others"), (6, "x y z"), (6, "p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", jaccard.text_key())
    root = {r.text_key: r.root for r in jaccard.near_roots(docs, 5, 80).collect()}
    keys = [r.text_key for r in docs.collect()]
    groups = [[i for i, k in enumerate(keys) if root[k] == x] for x in dict.fromkeys(root[k] for k in keys)]
    assert sorted(groups) == [[0, 1], [2, 3], [4], [5], [6]]
    got = [tuple(r) for r in jaccard.near_groups(docs, 5, 80).drop("text_key").collect()]
    assert sorted(got, key=str) == sorted([(None, 56, None), (None, 55, None), (None, 56, 4), (4, 55, 4), (4, 2, 4), (6, 1, 6), (6, 1, 6)], key=str)


def groups_of(rows, root):
    keys = [r.text_key for r in rows]
    return sorted([i for i, k in enumerate(keys) if root[k] == x] for x in dict.fromkeys(root[k] for k in keys))


def test_chains_through_null_and_repeated_ids(spark):
    """One id with two texts, and a null id between two others, against all pairs."""
    base, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    rows = [(7, base), (3, base[1:]), (7, other), (4, other[1:]), (1, base[8:] + base[:2]), (None, base[4:] + base[:1]), (2, ["only", "here"])]
    named = [(d, " ".join(t)) for d, t in rows]
    docs = spark.createDataFrame(named, "doc_id long, text string").withColumn("text_key", jaccard.text_key())
    root = {r.text_key: r.root for r in jaccard.near_roots(docs, 3, 80).collect()}
    want = {}
    for place, _, least in brute(list(enumerate(t for _, t in named)), 3, 80):
        want.setdefault(least, []).append(place)
    assert groups_of(docs.collect(), root) == sorted(want.values())
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(docs, 3, 80).collect()}
    assert {c for d, _, c in got if d is None} == {1} and {c for d, _, c in got if d == 7} == {1, 4}


def test_clashing_set_hashes_change_nothing(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, clashed = ({(r.doc_id, r.n_shingles): r.root for r in jaccard.near_roots(docs, 3, 90, bits).collect()} for bits in (64, 6))
    pairs = {(plain[k], clashed[k]) for k in plain if k[1]}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_sketches_never_differ_in_more_cells_than_sets_in_tokens():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 500))
        a = np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, len(a) + 1) :], rng.integers(0, 1 << 52, int(rng.integers(1, 60))).astype(np.uint64)]))
        x, y = jaccard.sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]))
        few = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, few), axis=0).view(np.uint64) for v in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_allocations_use_neighbourhoods_where_they_cost_less():
    for percent in (80, 90):
        table = jaccard.bands(percent)
        needed = [jaccard.most_apart(b.high, percent) + 1 for b in table]
        assert all(b.segments == 0 or b.segments + b.deletions >= n for b, n in zip(table, needed))
        both = [b for b in table if b.deletions and b.segments > b.deletions]
        assert both and all(b.high < 100 for b in both), table
