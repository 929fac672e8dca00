"""Alignment of the tokens that two tokenizers make of the same bytes.

Both tokenizations of a text are lists of byte offsets at which tokens end. A pointer goes
over each. The tokens under the pointers overlap and are a link; the pointer whose token
ends first moves on, and where both end at one offset both do, and the text is cut there.
The pointers of many texts are two numpy vectors and advance in lockstep: each step emits
a link of every text that isn't finished, and finished ones leave the vectors. Long texts
go as several lanes, parted at offsets where both tokenizers end a token.

Links of token ids are counted by documents over the whole corpus. A task codes the links
of a shard of documents by the shard's own sorted list of id pairs; these lists, not the
links, are summed, given the corpus' counts and sent back.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shards import cut, flat, write_shards
from .tables import stored

#: Tokens of a lane, about: a longer text is parted where it can be. Bytes of text that advance together.
LANE, TOGETHER = 512, 1 << 20
#: The sign for a space in pieces; runs of spaces with what follows; runs that are remembered, and characters of one, at most.
SPACE, RUN, CACHED, LONG_RUN = "\u2581", re.compile(" +[^ ]*"), 300_000, 64
#: An id pair as one number: the id of A times this, plus that of B.
PAIR = 1 << 32


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters
    themselves, the other bytes in order the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """A byte-level BPE vocabulary (JSON with vocab and merges): ids of texts, bytes of ids.

    The ids are those of the file's own library without special tokens; they are made by
    its faster peer, which takes the tokens' ranks. Ids of the file are ranks where a token
    was merged in the order of its id; a file for which that isn't so is refused.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {x["content"] for x in model["added_tokens"]}
        of = byte_level()
        self.bytes_of: list[bytes] = [b""] * (1 + max(model["model"]["vocab"].values()))
        ranks = {}
        for piece, i in model["model"]["vocab"].items():
            if piece not in special:
                self.bytes_of[i] = bytes(of[c] for c in piece)
                ranks[self.bytes_of[i]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        made = [model["model"]["vocab"][a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError(f"the ids of {path} don't follow its merges")
        self.known = vocabulary(self.bytes_of)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]


class Pieces:
    """A sentencepiece BPE model: ids of texts (it adds a space before each), bytes of ids.

    Where no piece has a space behind another character, no merge goes over the beginning of
    a run of spaces, and what lies between two such places is encoded once and remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [*map(self.model.id_to_piece, range(self.model.get_piece_size()))]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.known = vocabulary(self.bytes_of)
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.space = np.array([self.model.piece_to_id(SPACE)], np.int32).tobytes()
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        runs = [RUN.findall(" " + t) if t else [] for t in texts]
        fresh = [run for run in set().union(*runs) if run not in cache]
        # The model adds the first space of a run itself; to nothing it adds none.
        cache.update(zip(fresh, [array("i", ids).tobytes() for ids in self.model.encode([run[1:] for run in fresh], num_threads=1)]))
        cache[" "] = self.space
        out = [np.frombuffer(b"".join(map(cache.__getitem__, some)), np.int32) for some in runs]
        for run in fresh:
            if len(run) > LONG_RUN:
                del cache[run]
        return out


@lru_cache(4)
def _tokenizer(kind: type, path: str):
    """A worker keeps its tokenizers from task to task."""
    return kind(path)


class Side(NamedTuple):
    """Tokens of texts end to end: ids, byte offset at which each ends, and where each text's tokens begin."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray


class Vocabulary(NamedTuple):
    """The bytes of all ids end to end, where those of each begin, and their number."""

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray


def vocabulary(bytes_of: list[bytes]) -> Vocabulary:
    size = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))
    return Vocabulary(np.frombuffer(b"".join(bytes_of), np.uint8), np.cumsum(size) - size, size)


def _side(ids: list[np.ndarray], known: Vocabulary) -> Side:
    """The tokens of all texts; a text's offsets follow those of the one before."""
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    flat_ids = np.concatenate([np.zeros(0, np.int64), *ids])
    return Side(flat_ids, np.cumsum(known.size[flat_ids]), first)


def _given_back(side: Side, known: Vocabulary, wholes: list[bytes]) -> np.ndarray:
    """Whether each text's tokens join to its bytes."""
    upto = np.concatenate([[0], side.ends])[side.first]
    size = np.fromiter(map(len, wholes), np.int64, len(wholes))
    same = np.diff(upto) == size
    # The tokens of texts of the right length are spelled out and compared side by side.
    token = np.repeat(same, np.diff(side.first))
    ids = side.ids[token]
    length = known.size[ids]
    upto = np.cumsum(length)
    made = known.data[np.arange(upto[-1] if len(upto) else 0) + np.repeat(known.begin[ids] - (upto - length), length)]
    right = np.frombuffer(b"".join([w for w, s in zip(wholes, same) if s]), np.uint8)
    wrong = np.flatnonzero(made != right)
    ends = np.cumsum(size[same])
    same[np.flatnonzero(same)[np.searchsorted(ends, wrong, "right")]] = False
    return same


def _without(side: Side, keep: np.ndarray, known: Vocabulary) -> Side:
    """The side without the tokens of the other texts."""
    count = np.diff(side.first)
    ids = side.ids[np.repeat(keep, count)]
    return Side(ids, np.cumsum(known.size[ids]), np.concatenate([[0], np.cumsum(count * keep)]))


def _lanes(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first A, end of A, first B, end of B) of each lane: texts with tokens, long ones in parts."""
    begin_a, begin_b = a.first[:-1], b.first[:-1]
    size = np.diff(a.first)
    some = size > 0
    extra_a, extra_b = [], []
    for t in np.flatnonzero(size > LANE):
        ends_a, ends_b = a.ends[a.first[t] : a.first[t + 1]], b.ends[b.first[t] : b.first[t + 1]]
        place = np.searchsorted(ends_b, ends_a[:-1])
        both = np.flatnonzero(ends_b[place] == ends_a[:-1])  # tokens of A that end where one of B ends
        picked = both[np.unique(np.searchsorted(both, np.arange(LANE, size[t], LANE)).clip(max=max(len(both) - 1, 0)))] if len(both) else both
        extra_a.append(a.first[t] + picked + 1)
        extra_b.append(b.first[t] + place[picked] + 1)
    start_a, start_b = np.sort(np.concatenate([begin_a[some], *extra_a])), np.sort(np.concatenate([begin_b[some], *extra_b]))
    return start_a, np.append(start_a[1:], a.first[-1]), start_b, np.append(start_b[1:], b.first[-1])


def lockstep(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of all links, and (A token, B token) that end at each cut; places in the sides, in order.

    Every text's tokens of both sides end at the same last offset.
    """
    pa_, stop, pb_, _ = _lanes(a, b)
    links, cuts = [], []
    while len(pa_):
        links.append((pa_, pb_))
        end_a, end_b = a.ends[pa_], b.ends[pb_]
        both = end_a == end_b
        cuts.append((pa_[both], pb_[both]))
        pa_, pb_ = pa_ + (end_a <= end_b), pb_ + (end_b <= end_a)
        going = pa_ < stop
        if not going.all():
            pa_, pb_, stop = pa_[going], pb_[going], stop[going]
    out = []
    for found in (links, cuts):
        x, y = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        # Both pointers only rise along a text, so their sum orders what the steps have emitted.
        order = np.argsort(x + y, kind="stable")
        out += [x[order], y[order]]
    return tuple(out)


def spelled_groups(a: Side, b: Side, cut_a: np.ndarray, cut_b: np.ndarray) -> list[bytes]:
    """For each text its groups as ``a1,a2|b1;a3|b2,b3``, in decimal ids."""
    na, nb = len(a.ids), len(b.ids)
    # A group's tokens of A come first; before a token are all tokens of its own side and of the other side's earlier groups.
    group_a, group_b = np.searchsorted(cut_a, np.arange(na)), np.searchsorted(cut_b, np.arange(nb))
    place_a = np.arange(na) + np.concatenate([[0], cut_b + 1])[group_a]
    place_b = np.arange(nb) + (cut_a + 1)[group_b] if nb else np.zeros(0, np.int64)
    ids, sep = np.zeros(na + nb, np.int32), np.full(na + nb, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a.ids, b.ids
    sep[place_a[cut_a]], sep[place_b[cut_b]] = ord("|"), ord(";")
    width = len(str(int(ids.max(initial=0))))
    digits = np.zeros((len(ids), width + 1), np.uint8)
    rest = ids
    for k in range(width - 1, -1, -1):
        tenth = rest // 10
        digits[:, k] = rest - 10 * tenth + 48
        rest = tenth
    digits[:, width] = sep
    count = np.ones(len(ids), np.int64)
    for k in range(1, width):
        count += ids >= 10**k
    data = digits[np.arange(width + 1) >= (width - count)[:, None]]
    upto = np.concatenate([[0], np.cumsum(count + 1)])
    edge = upto[a.first + b.first].tolist()
    raw = data.tobytes()
    return [raw[x : max(y - 1, x)] for x, y in zip(edge, edge[1:])]


def align(texts: list[bytes], one: ByteBPE, other: Pieces) -> tuple[Side, Side, tuple]:
    """Both sides of the texts and their lockstep links and cuts. Texts that either tokenizer does not give back have no tokens."""
    said = [t.decode() for t in texts]
    wholes = [b" " + t for t in texts]
    sides = [_side(one.encode([" " + t for t in said]), one.known), _side(other.encode(said), other.known)]
    keep = np.fromiter(map(len, texts), np.int64, len(texts)) > 0
    for side, t in zip(sides, (one, other)):
        keep &= _given_back(side, t.known, wholes)
    if not keep.all():
        sides = [_without(side, keep, t.known) for side, t in zip(sides, (one, other))]
    return *sides, lockstep(*sides)


def _linked(texts: list[bytes], path_a: str, path_b: str) -> dict:
    """What a shard keeps of its texts: numbers and digests, and their distinct id pairs as CSR rows over the shard's sorted pairs."""
    one, other = _tokenizer(ByteBPE, path_a), _tokenizer(Pieces, path_b)
    columns = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    keys, counts, degree = [], [], []
    for first, n in cut([*map(len, texts)], TOGETHER):
        a, b, (link_a, link_b, cut_a, cut_b) = align(texts[first : first + n], one, other)
        row = np.searchsorted(a.first, link_a, "right") - 1
        pair = a.ids[link_a] * PAIR + b.ids[link_b]
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        fresh = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        keys.append(pair[fresh])
        counts.append(np.diff(np.append(fresh, len(row))))
        degree.append(np.bincount(row[fresh], minlength=n))
        spelled = spelled_groups(a, b, cut_a, cut_b)
        columns["n_a"] += np.diff(a.first).tolist()
        columns["n_b"] += np.diff(b.first).tolist()
        columns["n_groups"] += np.diff(np.searchsorted(cut_a, a.first)).tolist()
        columns["n_links"] += np.bincount(row, minlength=n).tolist()
        columns["groups_sha256"] += [hashlib.sha256(x).hexdigest() if x else "" for x in spelled]
    pairs, docs = np.unique(np.concatenate(keys), return_counts=True)
    return columns | {
        "pair_a": pairs // PAIR, "pair_b": pairs % PAIR, "docs": docs, "indptr": np.concatenate([[0], np.cumsum(np.concatenate(degree))]),
        "indices": np.searchsorted(pairs, np.concatenate(keys)), "times": np.concatenate(counts),
    }


def aligned_shards(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The written shards of the documents' alignments.

    ``rows`` has the documents' other columns; n_a, n_b, n_groups, n_links and groups_sha256
    have an entry for each; pair_a, pair_b and docs the shard's distinct linked id pairs and
    the number of its documents that hold each; indptr, indices and times the pairs of each
    document and how often it has them. Texts that are null, empty or not given back by a
    tokenizer have no tokens. Rows are aligned one by one, so repeated rows stay.
    """
    columns = (
        "n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
        "pair_a array<int>, pair_b array<int>, docs array<bigint>, indptr array<bigint>, indices array<int>, times array<int>"
    )
    return write_shards(docs, lambda texts: _linked(texts, path_a, path_b), columns, "alignment", text)


def pair_counts(shards: DataFrame) -> DataFrame:
    """(a, b, n, best): the documents that hold each linked id pair, and whether no pair of its A id has more."""
    entries = shards.select(F.explode(F.arrays_zip("pair_a", "pair_b", "docs")).alias("x")).select(F.col("x.pair_a").alias("a"), F.col("x.pair_b").alias("b"), F.col("x.docs").alias("n"))
    counts = stored(entries.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The documents' other columns with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best are the links whose id pair has the highest count of its A id, ties included;
    count_sum adds the counts of all links. Empty tables give empty ones.
    """
    shards = aligned_shards(docs, path_a, path_b, text)
    entries = shards.select("shard", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("place", "x"))
    known = entries.select("shard", "place", F.col("x.pair_a").alias("a"), F.col("x.pair_b").alias("b")).join(pair_counts(shards), ["a", "b"])
    sent = known.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("x"))
    joined = shards.drop("pair_a", "pair_b", "docs").join(sent.select("shard", F.col("x.n").alias("n"), F.col("x.best").alias("best")), "shard", "left")
    names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    row = shards.schema["rows"].dataType.elementType
    more = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    schema = T.StructType([*row.fields, *T.StructType.fromDDL(more).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                indptr, indices, times, n = (one.column(c).flatten().to_numpy() for c in ("indptr", "indices", "times", "n"))
                best = one.column("best").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                none = np.zeros(0, np.int64)
                summed, bests = (np.concatenate([[0], np.cumsum(times.astype(np.int64) * x[indices] if len(indices) else none)]) for x in (n, best))
                built = {c: one.column(c).flatten() for c in names} | {"count_sum": np.diff(summed[indptr]), "n_best": np.diff(bests[indptr])}
                yield flat(one.column("rows").flatten(), built, arrow)

    return joined.mapInArrow(run, schema)
