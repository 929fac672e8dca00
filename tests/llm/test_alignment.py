from collections import Counter
from hashlib import sha256
from itertools import accumulate

import public_tokenizers
import pytest

from millrace.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "hello world, this is a test of two tokenizers", "", None, "  x  y\t z\n", "한국어 문장입니다 é ａ", "a" * 50, "x", " ", "<s> <|endoftext|> </s>", "with ▁ inside",
    "x ", "x   ", "\n\n", "hello world, this is a test of two tokenizers", "the the the cat", "a" * 70 + "  b" * 40, "word " * 900, "naïve — “quotes” …",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, one, other):
    """A row for each text, from the tokenizers' own libraries and pairs of byte ranges."""
    of = alignment.byte_level()
    piece = lambda i: bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode()
    all_links, out = [], []
    for text in texts:
        text = text or ""
        a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
        said = [[bytes(of[c] for c in one.id_to_token(i)) for i in a], [piece(i) for i in b]]
        whole = (" " + text).encode()
        if not text or b"".join(said[0]) != whole or b"".join(said[1]) != whole:
            a = b = []
            said = [[], []]
        ends = [list(accumulate(map(len, x))) for x in said]
        spans = [list(zip([0, *e], e)) for e in ends]
        links = [(x, y) for x, (p, q) in zip(a, spans[0]) for y, (r, s) in zip(b, spans[1]) if p < s and r < q]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [",".join(str(i) for i, e in zip(a, ends[0]) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(b, ends[1]) if low < e <= high) for low, high in zip([0, *cuts], cuts)]
        all_links.append(links)
        out.append([len(a), len(b), len(cuts), len(links), sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(x for links in all_links for x in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return [(*row[:4], sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), row[4]) for row, links in zip(out, all_links)]


@pytest.mark.parametrize("lane, together, shard", [(512, 1 << 20, 1 << 22), (3, 60, 100)])
def test_against_pairs_of_byte_ranges(spark, monkeypatch, tokenizers, lane, together, shard):
    monkeypatch.setattr(alignment, "LANE", lane)
    monkeypatch.setattr(alignment, "TOGETHER", together)
    write = alignment.write_shards
    monkeypatch.setattr(alignment, "write_shards", lambda *a, **k: write(*a, **k, most=shard))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, shard long, n_a string").repartition(3)
    got = alignment.alignments(docs.select("doc_id", "text"), A, B).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(TEXTS, *tokenizers)


def test_lanes_are_the_links_of_the_whole(tokenizers):
    one, other = alignment.ByteBPE(A), alignment.Pieces(B)
    texts = [t.encode() for t in TEXTS if t]
    whole = alignment.align(texts, one, other)
    kept, alignment.LANE = alignment.LANE, 2
    try:
        parts = alignment.align(texts, one, other)
    finally:
        alignment.LANE = kept
    assert all((x == y).all() for x, y in zip(whole[2], parts[2]))


def test_runs_are_encoded_as_whole_texts(tokenizers):
    pieces = alignment.Pieces(B)
    texts = [t for t in TEXTS if t] + ["  leading", "a  b   c", "tab\tand\nline", "é" * 200]
    assert [x.tolist() for x in pieces.encode(texts)] == tokenizers[1].encode(texts)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    rows = alignment.alignments(docs, A, B).collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in rows) == [(False, 0, 0), (True, 2, 4), (True, 2, 4)]
    assert alignment.alignments(docs.limit(0), A, B).collect() == []
