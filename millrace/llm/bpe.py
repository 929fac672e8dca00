"""Byte-level BPE encoding and decoding.

Texts are cut into pieces without regular expressions. Every code point has a class;
a class, with what follows it, acts on the states of a small automaton, and prefix
compositions of these functions (an associative operation, done side by side over
rows of the text with a multiplication table) give the state before each code point
and so the boundaries. Pieces are then merged by rank, through a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .tables import widened

#: Unicode white space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers of Unicode 16 that older character tables lack.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)
#: Symbols: a class with what follows. White space comes as last of its run before a text goes on, or not.
(S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_SPACE_LAST, S_BLANK, S_BLANK_LAST, S_SHORT, S_LONG) = range(9)
#: States: what the code point before left. In a suffix such as 'll some letters are still to come.
(FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, ONE_MORE, TWO_MORE) = range(8)
#: Pieces held in the cache, about; code points cut at once; bytes from which a heap finds the next merge.
CACHED, CHUNK, LONG_PIECE, PLACED = 300_000, 1 << 19, 96, 1 << 14


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """For (state, symbol): the next state, and whether a piece begins before the code point."""
    opens = {S_OTHER: IN_OTHER, S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_SPACE: AFTER_SPACE, S_SPACE_LAST: AFTER_SPACE, S_BLANK: AFTER_BLANK, S_BLANK_LAST: AFTER_BLANK, S_SHORT: ONE_MORE, S_LONG: TWO_MORE}
    after, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    white = (S_SPACE, S_SPACE_LAST, S_BLANK, S_BLANK_LAST)
    quotes = (S_SHORT, S_LONG)
    for state in range(8):
        for symbol in range(9):
            after[state, symbol] = opens[symbol]
            if state == IN_LETTERS and symbol == S_LETTER or state == IN_NUMBERS and symbol == S_NUMBER:
                begins[state, symbol] = False
            elif state == IN_OTHER and symbol in (S_OTHER, *quotes) or state == AFTER_SPACE and symbol not in white:
                begins[state, symbol] = False
                after[state, symbol] = IN_OTHER if symbol in quotes else opens[symbol]
            elif state in (AFTER_SPACE, AFTER_BLANK) and symbol in (S_SPACE, S_BLANK):
                begins[state, symbol] = False
            elif state in (ONE_MORE, TWO_MORE) and symbol == S_LETTER:
                begins[state, symbol] = False
                after[state, symbol] = FREE if state == ONE_MORE else ONE_MORE
    return after, begins


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, products, what each element makes of FREE, begins).

    The elements are the functions on states that symbols generate. Symbols from 9 on
    are the first code points of texts: whatever came before, the state was FREE.
    """
    after, begins = _rules()
    symbols = [tuple(after[:, s]) for s in range(9)] + [(after[FREE, s],) * 8 for s in range(9)]
    index = {tuple(range(8)): 0}
    todo = list(index)
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(index)
                todo.append(h)
    assert len(index) < 256
    functions = np.array(list(index), np.uint8)
    product = np.array([[index[tuple(g[f])] for g in functions] for f in functions], np.uint8)
    return np.array([index[s] for s in symbols], np.uint8), product, functions[:, FREE].copy(), begins


def prefixes(elements: np.ndarray, product: np.ndarray, width: int = 512) -> np.ndarray:
    """Inclusive prefix products. Rows are scanned side by side, then joined by the scan of their totals."""
    n = len(elements)
    if n <= width:
        out, at = np.empty(n, np.uint8), 0
        for i, e in enumerate(elements):
            at = product[at, e]
            out[i] = at
        return out
    rows = -(-n // width)
    grid = np.zeros((rows, width), np.uint8)
    grid.ravel()[:n] = elements
    grid = np.ascontiguousarray(grid.T)
    for j in range(1, width):
        grid[j] = product[grid[j - 1], grid[j]]
    totals = prefixes(grid[-1], product, width)
    grid[:, 1:] = product[totals[:-1], grid[:, 1:]]
    return grid.T.ravel()[:n]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[list(WHITE)] = BLANK
    table[0x20] = SPACE
    table[0x27] = QUOTE
    return table


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points of texts laid end to end; ``firsts`` are where texts begin."""
    table = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_BLANK, S_OTHER], np.uint8)
    kind = classes()[points]
    symbol = table[kind]
    first = np.zeros(len(points) + 2, bool)
    first[firsts] = True
    first[len(points) :] = True
    ends = first[1 : len(points) + 1]
    white = (kind == SPACE) | (kind == BLANK)
    last = white & ~ends
    last[:-1] &= ~white[1:]
    symbol[last] += 1
    quote = np.flatnonzero(kind == QUOTE)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        near, far = ~first[quote + 1], ~(first[quote + 1] | first[quote + 2])
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        long = far & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        symbol[quote[short]] = S_SHORT
        symbol[quote[long]] = S_LONG
    element, product, of_free, begins = automaton()
    before = np.zeros(len(points), np.uint8)
    started = np.where(first[: len(points)], symbol + 9, symbol)
    before[1:] = of_free[prefixes(element[started], product)][:-1]
    return np.flatnonzero(begins[before, symbol] | first[: len(points)])


class Codec:
    """Encodes and decodes by a table of ranks (a file of lines "base64 rank")."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.decimal = {i: b"%d" % i for i in self.ranks.values()}
        # All token bytes in one pool: token i lies at pool[first[i] : first[i] + sizes[i]]; sizes of unused ids stay -1.
        self.sizes = np.full(max(self.ranks.values(), default=-1) + 1, -1, np.int64)
        ordered = sorted((i, piece) for piece, i in self.ranks.items())
        self.sizes[[i for i, _ in ordered]] = [len(piece) for _, piece in ordered]
        used = np.maximum(self.sizes, 0)
        self.first = np.cumsum(used) - used
        self.pool = np.frombuffer(b"".join(piece for _, piece in ordered), np.uint8)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece: the adjacent pair of lowest rank, leftmost of equals, is merged again and again."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = 1 << 60
        get = ranks.get
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, in n log n."""
        n, ranks = len(piece), self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := right[i]) < 0 or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [ranks[p] for p in parts if p is not None]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids in decimal, joined by spaces."""
        for chunk in _chunks(texts):
            joined = "".join(chunk)
            firsts = np.cumsum([0, *map(len, chunk)])
            begin = boundaries(np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.unique(firsts[:-1][np.diff(firsts) > 0])) if joined else np.zeros(0, np.int64)
            upto = np.searchsorted(begin, firsts).tolist()
            cut = [*begin.tolist(), len(joined)]
            pieces = [*map(joined.__getitem__, map(slice, cut, cut[1:]))]
            got = self._cached(pieces)
            for a, b in zip(upto, upto[1:]):
                yield b" ".join(got[a:b])

    def _cached(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, in decimal."""
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        got = [*map(cache.get, pieces)]
        merge, decimal = self.merge, self.decimal
        for i, ids in enumerate(got):
            if ids is None:
                piece = pieces[i]
                ids = cache.get(piece)
                if ids is None:
                    ids = b" ".join([decimal[x] for x in merge(piece.encode())])
                    if len(piece) <= LONG_PIECE:
                        cache[piece] = ids
                got[i] = ids
        return got

    def tokens(self, line: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a line, and their offsets: the byte at which each token begins."""
        ids = np.fromstring(line, np.int64, sep=" ") if line else np.zeros(0, np.int64)
        sizes = self.sizes[ids]
        return ids, np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """The bytes of tokens, each put at its offset, PLACED tokens at a time; offsets count from that of the first.

        Tokens may be any run of a text's, so a passage is decoded without what is before it.
        """
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any():
            raise ValueError("an id that the rank file doesn't have")
        at = starts - starts[0]
        out = np.zeros(at[-1] + self.sizes[ids[-1]], np.uint8)
        for i in range(0, len(ids), PLACED):
            some, sizes = ids[i : i + PLACED], self.sizes[ids[i : i + PLACED]]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[np.repeat(at[i : i + PLACED], sizes) + within] = self.pool[np.repeat(self.first[some], sizes) + within]
        return out.tobytes()


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, about CHUNK code points at a time."""
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def _slices(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """A few rows at a time, so that what they become doesn't add up in memory."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows]


_CODECS: dict[int, Codec] = {}


def _codec(sent) -> Codec:
    """A worker keeps one codec, and its cache, from task to task."""
    if sent.id not in _CODECS:
        _CODECS.clear()
        _CODECS[sent.id] = Codec(sent.value)
    return _CODECS[sent.id]


def _ranks(docs: DataFrame, path: str):
    """The rank file, under 1 MB, read once by the driver and sent to each executor."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(_Sent(file.read()))


class _Sent:
    def __init__(self, value: bytes):
        self.value, self.id = value, hashlib.sha256(value).hexdigest()


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``starts``, the byte at which each token begins, to the documents.

    A null text counts as empty and has no tokens. Columns of these names are replaced;
    all others are kept. Rows are encoded one by one, so repeated rows stay.
    """
    kept = docs.drop("ids", "starts")
    sent = _ranks(docs, path)
    schema = widened(kept.schema, "ids array<int>", "starts array<bigint>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(sent.value)
        for rows in _slices(batches):
            found = [codec.tokens(line) for line in codec.encode(rows[text].fillna("").tolist())]
            ids, starts = [i.astype(np.int32) for i, _ in found], [s for _, s in found]
            yield rows.assign(ids=ids, starts=starts)

    return kept.mapInPandas(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for by their offsets ``starts``; null ids or starts give null.

    Both arrays may be the same slice of a text's. Repeated rows stay; an empty table gives none.
    """
    kept = encoded.drop("decoded")
    sent = _ranks(encoded, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(sent.value)
        for batch in _slices(batches):
            yield batch.assign(decoded=[None if i is None or s is None else codec.decode(i.astype(np.int64), s) for i, s in zip(batch["ids"], batch["starts"])])

    return kept.mapInPandas(run, widened(kept.schema, "decoded binary"))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256, starts_sha256): digests of the ids, of what they decode to
    by their offsets, and of the offsets (little-endian, 8 bytes each).

    Null texts are empty and have no tokens; repeated rows stay; an empty table gives none; other columns aren't read.
    """
    sent = _ranks(docs, path)
    sha256 = lambda data: hashlib.sha256(data).hexdigest()
    schema = "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string, starts_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(sent.value)
        for batch in batches:
            rows = []
            for line in codec.encode(batch[text].fillna("").tolist()):
                ids, starts = codec.tokens(line)
                decoded = codec.decode(ids, starts)
                rows.append((len(ids), len(decoded), sha256(line), sha256(decoded), sha256(starts.astype("<i8").tobytes())))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][1:])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return docs.select("doc_id", text).mapInPandas(run, schema)
