import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        raw = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.Codec(raw), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, texts):
    codec, peer = both
    for text, line in zip(texts, codec.encode(texts), strict=True):
        assert [int(x) for x in line.split()] == peer.encode_ordinary(text), text
        ids, starts = codec.tokens(line)
        assert codec.decode(ids, starts) == text.encode()
        middle = slice(len(ids) // 3, 2 * len(ids) // 3)  # a passage by itself
        assert codec.decode(ids[middle], starts[middle]) == b"".join(map(peer.decode_single_token_bytes, ids[middle].tolist()))


def test_fixed_texts(both):
    same(both, ["", " ", "  a", "don't 'tis 'S 'll've're!'s 's''s", "a\n\n b \t c  ", "x" * 30_000, "ab " * 5000, "　\u0085\x1c1２½", "é😀ß" * 200, "'", "a'", "'r", "'v"])
    same(both, ["a", "'s", "'l", "l", " ", " b", "\n", "c"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text(alphabet="ab 'sdltrve\n\t1!　é", max_size=80)), max_size=8))
def test_random_texts(both, texts):
    same(both, texts)


def test_scan_widths(both):
    element, product, _, _ = bpe.automaton()
    given_ = element[np.random.default_rng(0).integers(0, 18, 3001)]
    want, at = [], 0
    for e in given_:
        at = product[at, e]
        want.append(at)
    for width in (2, 7, 512, 5000):
        assert bpe.prefixes(given_, product, width).tolist() == want


def test_columns(spark, both):
    texts = [None, "", "hello  world 😀", "hello  world 😀"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert r.ids == both[1].encode_ordinary(t or "") and bytes(r.decoded).decode() == (t or "")
        pieces = [both[1].decode_single_token_bytes(i) for i in r.ids]
        assert r.starts == [sum(map(len, pieces[:i])) for i in range(len(pieces))]
    line = " ".join(map(str, both[1].encode_ordinary(texts[2])))
    digests = bpe.digests(docs, PATH).orderBy("doc_id").collect()
    assert digests[2].ids_sha256 == hashlib.sha256(line.encode()).hexdigest() and digests[2].n_tokens == len(line.split())
    assert digests[0].n_tokens == 0 and digests[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    starts = b"".join(x.to_bytes(8, "little") for x in rows[2].starts)
    assert digests[2].starts_sha256 == hashlib.sha256(starts).hexdigest() and digests[2][1:] == digests[3][1:]
    assert bpe.encode(docs.limit(0), PATH).count() == 0 == bpe.digests(docs.limit(0), PATH).count()
    assert bpe.decode(bpe.encode(docs, PATH).withColumn("starts", F.lit(None).cast("array<bigint>")), PATH).filter("decoded IS NOT NULL").count() == 0
    part = bpe.decode(bpe.encode(docs, PATH).withColumns({"ids": F.slice("ids", 2, 2), "starts": F.slice("starts", 2, 2)}), PATH).orderBy("doc_id").collect()
    assert bytes(part[2].decoded) == b" " + b" world" and bytes(part[0].decoded) == b""


def test_unknown_ids(both):
    for bad in ([60_000], [-1]):
        with pytest.raises(ValueError):
            both[0].decode(np.array(bad), np.zeros(1, np.int64))
