from collections import Counter
from itertools import permutations

from millrace.llm import audit

LONG = " ".join(f"w{i}" for i in range(210))
DOCS = [
    (1, "en", LONG), (2, "en", LONG), (2, "en", LONG), (3, "de", LONG), (4, None, ""), (5, "", None), (6, "en", "SHOUT " * 210), (7, "de", "x$ " * 3),
    (8, "de", LONG + " #"), (None, "en", LONG), (9, "de", "A" + LONG), (10, "fr", "a b  c d e\x0bf\x1cg"), (11, "fr", "É" * 40), (12, "fr", "same same " * 150),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (6, 0, 1), (8, None, 1), (None, 1, 1), (99, 1, 1), (12, 1, 1)]


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, _, text in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = []
    for d, lang, text in docs:
        text = text or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > least[text],
        }
        rows.append((lang or "", {x for x in fails if fails[x]}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        every = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(every[f])
    return out


def test_all_orders(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, lang string, text string, digest string, failed int").repartition(3)
    got = audit.interactions(audit.failures(docs), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == brute(DOCS, LABELS)
    assert len(got) == 4 * 120 * 5


def test_matrix_holds_the_words(spark, monkeypatch):
    write = audit.write_shards
    monkeypatch.setattr(audit, "write_shards", lambda *a: write(*a[:-1], most=20))
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c a\tA " * 9), (5, "d")], "shard long, text string").repartition(2)
    matrix, dictionary = audit.document_term_matrix(docs)
    words = {r.idx: r.word for r in dictionary.collect()}
    assert sorted(words) == list(range(5)) and set(words.values()) == {"a", "b", "c", "A", "d"}
    said = {}
    for r in matrix.collect():
        for i, row in enumerate(r.rows):
            some = slice(r.indptr[i], r.indptr[i + 1])
            assert len({*r.indices[some]}) == len(r.indices[some])
            said[row.shard] = {words[x]: n for x, n in zip(r.indices[some], r.data[some])}
    assert said == {1: {"b": 2, "a": 1}, 2: {}, 3: {}, 4: {"c": 9, "a": 9, "A": 9}, 5: {"d": 1}}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, lang string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.failures(docs), labels).collect() == []
    some = spark.createDataFrame([(1, "en", "a")], docs.schema)
    assert {r.kept for r in audit.interactions(audit.failures(some), labels).collect()} == {0, 1}
