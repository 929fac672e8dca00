"""GIF as a media column: frames are decoded into rows with their time and colours.

The LZW decoder works on whole code streams at a time. After a clear code the width of
each code depends on its place alone, so codes are unpacked together. A code's string
is what stands in the output where its prefix began, one byte longer; following these
references by pointer doubling gives all lengths, then all bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the format.
EXTENSION, IMAGE, TRAILER, CONTROL = 0x21, 0x2C, 0x3B, 0xF9
TABLE, WIDEST = 4096, 12
#: Layout of stored payloads: samples in a line, lines in a frame, hundredths of a second that a frame shows.
LINE, LINES, DELAY = 64, 1024, 10
#: Bits of each channel that a histogram's bins keep.
BIN_BITS = 2


class Frame(NamedTuple):
    """One frame: where its image lies, when it shows (hundredths of a second), and the whole canvas."""

    left: int
    top: int
    width: int
    height: int
    start: int
    delay: int
    disposal: int
    transparent: int
    canvas: np.ndarray


@lru_cache(64)
def code_widths(size: int, count: int) -> np.ndarray:
    """Bits of the first ``count`` codes after a clear code, for a minimum code size."""
    known = (1 << size) + 2 + np.maximum(np.arange(count) - 1, 0)
    widths = np.full(count, size + 1)
    for width in range(size + 1, WIDEST):
        widths += known >= 1 << width
    return widths


def lzw_decode(data: bytes, size: int, wanted: int) -> np.ndarray:
    """The samples of a code stream, ``wanted`` at most; a stream that ends early gives fewer."""
    clear, stop = 1 << size, (1 << size) + 1
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    bits, at, out, got, plan = len(data) * 8, 0, [], 0, TABLE
    while at < bits and got < wanted:
        widths = code_widths(size, plan)
        ends = np.cumsum(widths)
        count = int(np.searchsorted(ends, bits - at, "right"))
        where = at + ends[:count] - widths[:count]
        byte = where >> 3
        codes = (padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16) >> (where & 7).astype(np.uint32) & ((1 << widths[:count]) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        if not len(marks) and count == plan:
            plan *= 4  # a long stretch without a clear code: unpack more of it
            continue
        n = int(marks[0]) if len(marks) else count
        if n:
            part = _strings(codes[:n].astype(np.int64), stop)
            out.append(part)
            got += len(part)
        if not len(marks) or codes[n] == stop:
            break
        at += int(ends[n])
    return np.concatenate(out)[:wanted] if out else np.zeros(0, np.uint8)


def _strings(codes: np.ndarray, stop: int) -> np.ndarray:
    """The output of codes that follow one clear code."""
    here = np.arange(len(codes))
    refers = codes > stop
    prefix = np.where(refers, codes - stop - 1, here)
    if (prefix[refers] >= here[refers]).any():
        raise ValueError("a code refers to a string that isn't there yet")
    length, root = refers.astype(np.int64), prefix
    while True:
        more = length[root]
        if not more.any():
            break
        length = length + more
        root = root[root]
    length += 1
    ends = np.cumsum(length)
    starts = ends - length
    source = np.arange(int(ends[-1]))
    source += np.repeat(np.where(refers, starts[prefix] - starts, 0), length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    samples = np.zeros(int(ends[-1]), np.uint8)
    samples[starts[~refers]] = codes[~refers]
    return samples[source]


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as a code stream; the table is cleared whenever it is full."""
    clear, stop = 256, 257
    runs: list[list[int]] = []
    table: dict[int, int] = {}  # (code << 8 | byte) -> code << 8
    codes, free, full = [], (stop + 1) << 8, TABLE << 8
    put = codes.append
    now = data[0] << 8
    for byte in memoryview(data)[1:]:
        key = now | byte
        if key in table:
            now = table[key]
            continue
        put(now)
        if free < full:
            table[key] = free
            free += 256
        else:
            put(clear << 8)
            runs.append(codes)
            table.clear()
            codes, free = [], (stop + 1) << 8
            put = codes.append
        now = byte << 8
    put(now)
    put(stop << 8)
    runs.append(codes)
    widths = np.concatenate([[9], *(code_widths(8, len(r)) for r in runs)])
    values = np.concatenate([[clear << 8], *runs]).astype(np.uint64) >> np.uint64(8)
    ends = np.cumsum(widths)
    where = ends - widths
    total = int(ends[-1])
    words = np.zeros(total // 64 + 2, np.uint64)
    word, shift = where >> 6, (where & 63).astype(np.uint64)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[new]] = np.bitwise_or.reduceat(values << shift, new)
    over = np.flatnonzero(shift.astype(np.int64) + widths > 64)
    words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return words.astype("<u8").tobytes()[: (total + 7) // 8]


def _blocks(data: bytes) -> bytes:
    """Data as sub-blocks of up to 255 bytes and the one that ends them."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _unblocked(gif: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := gif[at]:
        parts.append(gif[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def encode_payload(payload: bytes) -> bytes:
    """Bytes, a positive multiple of LINE, as the samples of an animation.

    The palette's colour i is the grey i. Frames have up to LINES lines, are kept in
    place by the next one, and show for DELAY.
    """
    lines = len(payload) // LINE
    grey = bytes(x for i in range(256) for x in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", LINE, min(lines, LINES), 0xF7, 0, 0), grey]
    for top in range(0, lines, LINES):
        part = payload[top * LINE : (top + LINES) * LINE]
        out.append(struct.pack("<BBBBHBB", EXTENSION, CONTROL, 4, 1 << 2, DELAY, 0, 0))
        out.append(struct.pack("<BHHHHB", IMAGE, 0, 0, LINE, len(part) // LINE, 0))
        out.append(b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, bytes([TRAILER])])


def decode(gif: bytes) -> Iterator[Frame]:
    """The frames of a GIF, each with the canvas (height, width, RGB) as it then shows.

    Transparent samples leave what is there. Disposal 2 clears a frame's own rectangle
    afterwards (to black), 3 brings back what was there before it.
    """
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", gif[6:13])
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(gif, np.uint8, size, at).reshape(-1, 3), at + size
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, transparent, start = 0, 0, -1, 0
    while gif[at] != TRAILER:
        kind = gif[at]
        if kind == EXTENSION:
            label = gif[at + 1]
            body, after = _unblocked(gif, at + 2)
            if label == CONTROL and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            at = after
            continue
        if kind != IMAGE:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack("<HHHHB", gif[at + 1 : at + 10])
        at, palette = at + 10, shared
        if flags & 0x80:
            size = 3 << ((flags & 7) + 1)
            palette, at = np.frombuffer(gif, np.uint8, size, at).reshape(-1, 3), at + size
        if palette is None:
            raise ValueError("an image without a palette")
        size = gif[at]
        data, at = _unblocked(gif, at + 1)
        samples = lzw_decode(data, size, w * h)
        whole = np.full(w * h, transparent if transparent >= 0 else 0, np.int64)
        whole[: len(samples)] = samples
        image = whole.reshape(h, w)
        if flags & 0x40:
            lines = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(image)
            straight[lines] = image
            image = straight
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        image = image[: part.shape[0], : part.shape[1]]
        if transparent >= 0:
            seen = image != transparent
            part[seen] = palette[np.minimum(image[seen], len(palette) - 1)]
        else:
            part[...] = palette[np.minimum(image, len(palette) - 1)]
        yield Frame(left, top, w, h, start, delay, disposal, transparent, canvas.copy())
        if disposal == 2:
            part[...] = 0
        elif before is not None:
            canvas = before
        start, delay, disposal, transparent = start + delay, 0, 0, -1


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Pixels in each colour bin, BIN_BITS a channel, red highest."""
    kept = (pixels.reshape(-1, 3) >> (8 - BIN_BITS)).astype(np.int64)
    return np.bincount(kept[:, 0] << 2 * BIN_BITS | kept[:, 1] << BIN_BITS | kept[:, 2], minlength=1 << 3 * BIN_BITS)


FRAMES = "frame int, start_cs long, delay_cs int, disposal int, left int, top int, width int, height int, canvas_width int, canvas_height int, rgb binary, histogram array<long>, error string"


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per frame: the key, time, place, the canvas as RGB bytes and its colour histogram.

    A null or unreadable GIF gives one row with ``error`` and nulls; other columns than
    the key are not carried. Frames are decoded one at a time.
    """
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for which, gif in zip(batch["key"], batch["media"]):
                try:
                    if gif is None:
                        raise ValueError("null")
                    for i, f in enumerate(decode(bytes(gif))):
                        row = (i, f.start, f.delay, f.disposal, f.left, f.top, f.width, f.height, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas), None)
                        yield pd.DataFrame([(which, *row)], columns=["key", *names])
                except (ValueError, IndexError, struct.error) as error:
                    row = (*[None] * (len(names) - 1), str(error))
                    yield pd.DataFrame([(which, *row)], columns=["key", *names], dtype=object)

    kind = media.schema[key].dataType.simpleString()
    return media.selectExpr(f"`{key}` AS key", f"`{column}` AS media").mapInPandas(run, f"key {kind}, {FRAMES}").withColumnRenamed("key", key)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 of each whole text (null: empty), padded with 0 to lines, as a GIF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch):
                payloads = [t.encode() for t in part[text].fillna("")]
                media = [encode_payload(p + bytes(-len(p) % LINE or (not p) * LINE)) for p in payloads]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_bytes": [len(p) for p in payloads], "media": media})

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def _parts(batch: pd.DataFrame, rows: int = 512) -> Iterator[pd.DataFrame]:
    for i in range(0, len(batch), rows):
        yield batch.iloc[i : i + rows]


def read_payloads(media: DataFrame) -> DataFrame:
    """Reads stored payloads back through the decoder and digests them.

    Each frame's samples are its canvas's greys. ``feature`` has the number of frames,
    the shown time, and the colour histogram of all frames' samples by brightness.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, shown_cs long, feature string"
    grey = np.array([b << 2 * BIN_BITS | b << BIN_BITS | b for b in range(1 << BIN_BITS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, n, gif in zip(batch["doc_id"], batch["n_bytes"], batch["media"]):
                digest, size, tail, count, shown = hashlib.sha256(), 0, b"", 0, 0
                bins = np.zeros(1 << 3 * BIN_BITS, np.int64)
                for f in decode(gif):
                    image = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
                    part = image[..., 0].tobytes()
                    digest.update(part)
                    bins += histogram(image)
                    size, tail, count, shown = size + len(part), part[-64:], count + 1, f.start + f.delay
                feature = f"frames={count};cs={shown};bins={','.join(map(str, bins[grey]))}"
                rows.append((key, n, size, digest.hexdigest(), zlib.crc32(tail), len(gif), hashlib.sha256(gif).hexdigest(), count, shown, feature))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, schema)
