"""The pipeline's stages, each on its own input, against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from .test_jaccard import sets_of
from .test_secrets import brute as secrets_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{path}/{i}")
        after = spark.read.parquet(f"{path}/{i}")
        out.append((docs, after))
        docs = after
    return out


def test_columns_are_kept(stages):
    columns = stages[0][0].columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_quality_keeps_most_documents(stages):
    before, after = stages[0]
    assert 0.7 * before.count() < after.count() < before.count()


def test_one_of_each_group_stays(stages):
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in stages[1])
    sets = {d: sets_of(t, 5) for d, t in before.items()}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ids = sorted(before)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(after) == sorted({find(d) for d in ids}) and len(after) < len(before)


def test_secrets_are_masked_and_clean_texts_kept(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[2])
    assert before.keys() == after.keys()
    for d, r in before.items():
        found = secrets_of(r.text)
        assert bool(found) == (after[d].text != r.text)
        assert secrets_of(after[d].text) == "" and after[d].n_chars == (len(after[d].text) if found else r.n_chars)


def test_mix_takes_whole_documents(stages):
    before, after = stages[3]
    sizes = {r.doc_id: r.text for r in before.collect()}
    copies = Counter(r.doc_id for r in after.collect())
    assert set(copies) <= set(sizes) and max(copies.values()) <= 2
    total = sum(len(t.split()) for t in sizes.values())
    taken = sum(len(sizes[d].split()) * n for d, n in copies.items())
    assert abs(taken - 1.5 * total) < 0.1 * total


def test_tokens_decode_to_the_texts(spark, stages):
    from millrace.llm import bpe

    before, after = stages[4]
    decoded = bpe.decode(after, pipeline.RANKS).select("doc_id", F.col("decoded").cast("string").alias("text"))
    assert sorted(tuple(r) for r in decoded.collect()) == sorted((r.doc_id, r.text) for r in before.collect())


def test_odd_rows_pass_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", "a", 3), (3, "token=abcdefghijklmnop", "en", None, 22), (3, "token=abcdefghijklmnop", "en", None, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.without_secrets(spark, docs, SMALL).count() == 5
    assert pipeline.without_near_duplicates(spark, docs, SMALL).count() == 4
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_unrelated_documents_of_null_or_repeated_ids_stay(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (7, "m n o p q r"), (7, "s t u v w x"), (None, near), (None, near + " more"), (8, near + " less")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.without_near_duplicates(spark, docs, SMALL).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([*rows[:4], rows[6]], key=str)


def test_columns_of_any_name_pass_through(spark):
    names = ["_before", "before", "_key", "KEY", "_copies", "copies", "_copy", "copy", "score", "found", "text_key", "given_score", "held_out", "size"]
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    secret = [(1000 + i, f"word{i} and token=abcdefghijklm{i:03d} here", "en", "a", 40) for i in range(20)]
    docs = rows.unionByName(spark.createDataFrame(secret, rows.schema))
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    spark.conf.set("spark.sql.caseSensitive", "false")
    for _, stage in pipeline.STAGES[:4]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        told = after.collect()
        assert told and all(r[n] == f"{n}{r.doc_id}" for r in told for n in names)
        if stage is pipeline.without_secrets:
            assert len(told) == 50 and not any("token=abcdef" in str(v) for r in told for v in r)
