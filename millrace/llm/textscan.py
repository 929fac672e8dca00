"""Words and their hashes for many texts at once, in numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

#: Odd multiplier for chains of hashes; words of more bytes are hashed by BLAKE2 on their own.
BASE, LONG = 0x9E3779B97F4A7C15, 256
#: Bytes of text looked at together, about; a longer text goes alone.
CHUNK = 1 << 19
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its lanes of eight bytes go through a chain of mixing steps, all words side by side."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    out = mixed(length.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    active, at = np.flatnonzero(length <= LONG), 0
    while len(active):
        left = length[active] - at
        lane = lanes[starts[active] + at]
        short = left < 8
        lane[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[active] = mixed(out[active] * np.uint64(BASE) ^ lane)
        active = active[left > 8]
        at += 8
    for i in np.flatnonzero(length > LONG):
        out[i] = int.from_bytes(blake2b(data[starts[i] : starts[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def chunks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8, some at a time, with the index of the first."""
    part, size, first = [], 0, 0
    for i, text in enumerate(texts):
        data = text.encode()
        if part and size + len(data) > CHUNK:
            yield first, part
            part, size, first = [], 0, i
        part.append(data)
        size += len(data)
    if part:
        yield first, part


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, length in bytes, text) of each word, and the bytes of all texts end to end, each closed by a blank."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = LOWER[data]
    blank = WHITE[data]
    edge = np.diff(blank, prepend=True, append=True)
    starts, ends = np.flatnonzero(edge[:-1] & ~blank), np.flatnonzero(edge[:-1] & blank)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, data
    length = ends - starts
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return _word_hashes(data, starts, length), length, np.searchsorted(firsts, starts, "right") - 1, data
