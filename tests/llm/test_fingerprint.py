import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprint


def words(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w)


def similarity(a, b):
    a, b = words(a), words(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def plain(rows):
    """By one sorted list: the edited text and both similarities of every row."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), similarity(t, edited), similarity(t, after)))
    return out


def test_every_row_against_plain_python(spark):
    rows = [(i * 37 % 1009, f"{'é😀 ' * (i % 3)}" + " ".join(f"w{(i * j) % 50}" for j in range(i % 90))) for i in range(300)]
    rows += [(5, None), (6, ""), (7, "odd x"), (8, "w " * 60_000), (37, "same id, other text")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, range int")
    got = fingerprint.fingerprints(docs).collect()
    want = plain(rows)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(w[:3] for w in want)
    exact = {w[:3]: w for w in want}
    off = [(r.near_edited - exact[r[:3]][3], r.near_next - exact[r[:3]][4]) for r in got]
    for side in (0, 1):
        # The texts share their words and so their draws: errors don't cancel over documents.
        assert abs(sum(o[side] for o in off) / len(off)) < 0.03
        assert max(abs(o[side]) for o in off) < 0.35 and (sum(o[side] ** 2 for o in off) / len(off)) ** 0.5 < 0.07


def test_collisions_follow_weights(spark):
    """The share of equal samples estimates sum of minima over sum of maxima, for weights that aren't whole too."""
    left, right = {i: 1 + i % 7 for i in range(40)}, {i: 0.5 + (i * 3) % 9 for i in range(10, 60)}
    rows = [("l", t, float(w)) for t, w in left.items()] + [("r", t, float(w)) for t, w in right.items()]
    terms = spark.createDataFrame(rows, "of string, term long, weight double")
    got = {r.of: r.samples for r in fingerprint.minima(terms, ["of"], {"weight": "samples"}, 2048).collect()}
    every = set(left) | set(right)
    want = sum(min(left.get(t, 0), right.get(t, 0)) for t in every) / sum(max(left.get(t, 0), right.get(t, 0)) for t in every)
    assert sum(a == b for a, b in zip(got["l"], got["r"])) / 2048 == pytest.approx(want, abs=0.035)


def test_ends_and_empty_tables(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(None, "ab cd")], "doc_id long, text string")).collect()
    assert (one[0].doc_id, one[0].near_next) == (None, 1.0)
    assert one[0].edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = fingerprint.fingerprints(spark.createDataFrame([(1, "x y")] * 3 + [(2, "x y"), (3, "")], "doc_id long, text string"))
    rows = twice.select("doc_id", fingerprint.spelled(F.col("samples")).alias("f"), "near_next").collect()
    assert len({r.f for r in rows if r.doc_id < 3}) == 1 and [r.f for r in rows if r.doc_id == 3] == ["0" * 512]
    assert len(rows) == 5 and sorted(r.near_next for r in rows) == [0.0, 0.0, 1.0, 1.0, 1.0]
