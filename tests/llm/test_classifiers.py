import itertools

import numpy as np
import pytest

from millrace.llm import language, quality, queries, textscan

SMALL = "/root/testdata/sf0.01"


def test_words_and_hashes():
    texts = [b"", b"  ", b"One two\tone\x0b three", "é 😀 é".encode(), b"one"]
    hashes, length, which, _ = textscan.words(texts, lower=True)
    spelled = [(i, w) for i, t in enumerate(texts) for w in t.lower().split()]
    assert which.tolist() == [i for i, _ in spelled] and length.tolist() == [len(w) for _, w in spelled]
    seen = {}
    for h, (_, w) in zip(hashes.tolist(), spelled):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    size = quality.BUCKETS + len(quality.STATS)
    model = quality.Model(0.3, rng.normal(size=size), rng.normal(0, 0.3, (size, quality.RANK)), rng.normal(size=len(quality.STATS)), np.ones(len(quality.STATS)))
    texts = [b"", b"a b c a", b"%%% LOUD, words! 12\n" * 3]
    docs, index, value = quality._joined(model, *quality.features(texts))
    for d, got in enumerate(quality.score(model, texts)):
        mine = [(j, x) for t, j, x in zip(docs, index, value) if t == d]
        raw = model.base + sum(model.weight[j] * x for j, x in mine)
        raw += sum(model.vectors[a] @ model.vectors[b] * x * y for (a, x), (b, y) in itertools.combinations(mine, 2))
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op6_quality(spark, SMALL).collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert len(rows) == 1000 and len(held) > 60
    assert np.mean([p == q for p, q in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 300_000, "x"), (3, "w", "x")], "doc_id long, text string, score string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 4
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, None), (9, 1)], "doc_id long, quality int"))
    assert quality.classify(docs, one).first().score == pytest.approx(2 / 3)
    two = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in quality.classify(docs, two).collect()}
    assert scores[1] == scores[2]
    assert quality.classify(docs.limit(0), two).count() == 0


def test_language_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op9_language(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()
    held = [(rows[r.doc_id].lang_pred, r.lang) for r in docs if rows[r.doc_id].held_out]
    assert len(held) > 250 and np.mean([p == q for p, q in held]) > 0.97


def test_language_edges(spark):
    rows = [(1, "en", "the cat and the dog " * 9), (2, "fr", "le chat et le chien é " * 9), (3, None, None), (4, "en", "123 !!"), (5, None, "THE DOG"), (6, "fr", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs.drop("lang"), model).collect()}
    assert got[3] == got[4] == got[6] == ("und", 0.0)
    assert got[1][0] == got[5][0] == "en" and got[2][0] == "fr" and all(0 <= s <= 1 for _, s in got.values())
    empty = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_bayes_matches_plain_sums():
    model = language.Model(["x", "y"], np.log([0.4, 0.6]), np.log(np.random.default_rng(0).dirichlet(np.ones(language.BUCKETS), 2)))
    text = "Ab, cd é"
    _, buckets, _ = language.grams([text])
    total = model.log_prior + sum(model.log_likelihood[:, b] for bs in buckets for b in bs if b >= 0)
    names, chance = language.predict(model, [text])
    assert names[0] == model.languages[int(total.argmax())]
    assert chance[0] == pytest.approx(np.exp(total.max()) / np.exp(total).sum(), rel=1e-4) or chance[0] == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-4)
