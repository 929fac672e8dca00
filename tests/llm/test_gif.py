import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import gif


def slow_decode(data, size):
    """The format's own rules, a code at a time."""
    clear, stop = 1 << size, (1 << size) + 1
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    at, width, table, last, out = 0, size + 1, {}, None, bytearray()
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            width, table, last = size + 1, {i: bytes([i]) for i in range(clear)}, None
            free = stop + 1
            continue
        if code == stop:
            break
        now = table[code] if code in table else last + last[:1]
        out += now
        if last is not None and free < 4096:
            table[free] = last + now[:1]
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        last = now
    return bytes(out)


def slow_encode(data, size, clears=True):
    """Codes of a plain encoder; without clears the full table stays in use."""
    clear, stop = 1 << size, (1 << size) + 1
    bits, width = [], size + 1

    def put(code):
        bits.append(f"{code:0{width}b}"[::-1])

    put(clear)
    table, free, now, first = {bytes([i]): i for i in range(clear)}, stop + 1, b"", True
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now])
        if not first and seen < 4096 and seen == 1 << width and width < 12:
            pass
        if free < 4096:
            table[now + bytes([b])] = free
            free += 1
        first, seen = False, free
        if free - 1 == 1 << width and width < 12:
            width += 1
        now = bytes([b])
    put(table[now])
    if free == 1 << width and width < 12 and free < 4096:
        width += 1
    put(stop)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))


def blocks(data):
    return b"".join(bytes([len(data[i : i + 200])]) + data[i : i + 200] for i in range(0, len(data), 200)) + b"\0"


def image(left, top, w, h, samples, size=2, flags=0, palette=b""):
    return struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + palette + bytes([size]) + blocks(slow_encode(samples, size))


def control(delay, disposal=0, transparent=None):
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
R, G, B = (255, 0, 0), (0, 255, 0), (0, 0, 255)


def whole(w, h, *parts):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + PALETTE + b"".join(parts) + b";"


def pixels(frame):
    return [[tuple(int(x) for x in p) for p in line] for line in frame.canvas]


def test_disposal_transparency_and_time():
    data = whole(
        2, 2,
        control(5, 1), image(0, 0, 2, 2, bytes([1, 1, 1, 1])),
        b"\x21\xfe\x03abc\x00",
        control(7, 2, 0), image(0, 0, 2, 1, bytes([0, 2])),
        control(9, 3), image(1, 1, 1, 1, bytes([3])),
        image(0, 1, 1, 1, bytes([2])),
    )
    frames = list(gif.decode(data))
    assert [(f.start, f.delay, f.disposal, f.transparent) for f in frames] == [(0, 5, 1, -1), (5, 7, 2, 0), (12, 9, 3, -1), (21, 0, 0, -1)]
    black = (0, 0, 0)
    assert pixels(frames[0]) == [[R, R], [R, R]]
    assert pixels(frames[1]) == [[R, G], [R, R]]
    assert pixels(frames[2]) == [[black, black], [R, B]]
    assert pixels(frames[3]) == [[black, black], [G, R]]


def test_interlace_and_local_palette():
    lines = [bytes([i % 4]) for i in range(9)]
    order = [*range(0, 9, 8), *range(4, 9, 8), *range(2, 9, 4), *range(1, 9, 2)]
    local = bytes(reversed(PALETTE))
    data = whole(1, 9, image(0, 0, 1, 9, b"".join(lines[i] for i in order), 2, 0x40 | 0x81, local))
    (frame,) = gif.decode(data)
    table = np.frombuffer(local, np.uint8).reshape(-1, 3)
    assert (frame.canvas[:, 0] == table[[i % 4 for i in range(9)]]).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 8), st.data())
def test_streams_decode_as_the_rules_say(size, data):
    samples = bytes(x % (1 << size) for x in data.draw(st.binary(min_size=1, max_size=600)))
    stream = slow_encode(samples, size)
    assert slow_decode(stream, size) == samples
    assert gif.lzw_decode(stream, size, len(samples)).tobytes() == samples


def test_a_full_table_without_clear_codes():
    samples = np.random.default_rng(1).integers(0, 16, 60_000).astype(np.uint8).tobytes()
    stream = slow_encode(samples, 4)
    assert gif.lzw_decode(stream, 4, len(samples)).tobytes() == samples


@pytest.mark.parametrize("payload", [bytes(64), b"ab" * 3200, np.random.default_rng(2).bytes(64 * 1500), b"the and of " * 64 * 100])
def test_encoder_is_read_by_the_rules(payload):
    stream = gif.lzw_encode(payload)
    assert slow_decode(stream, 8) == payload and gif.lzw_decode(stream, 8, len(payload)).tobytes() == payload


def test_bad_files():
    for bad in (b"", b"PNG", whole(1, 1)[:10], whole(1, 1, b"\x99")):
        with pytest.raises((ValueError, IndexError, struct.error)):
            list(gif.decode(bad))
    assert gif.lzw_decode(b"", 8, 10).tobytes() == b""


def test_stored_texts_are_read_back(spark):
    texts = [None, "", "a" * 64, "é😀" * 50, "long words and lines\n" * 20_000, "dup", "dup"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    rows = sorted(gif.read_payloads(gif.store_texts(docs)).collect())
    for r, t in zip(rows, texts, strict=True):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded)) and len(padded) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    assert rows[4].n_frames == 7 and rows[5].feature == rows[6].feature


def test_frames_table(spark):
    data = whole(2, 1, control(5), image(0, 0, 2, 1, bytes([1, 2])), control(6), image(0, 0, 1, 1, bytes([3])))
    media = spark.createDataFrame([(1, data, "x"), (2, None, "x"), (3, b"junk", "x")], "doc_id long, media binary, frame string")
    rows = sorted(gif.frames(media).collect(), key=lambda r: (r.doc_id, r.frame or 0))
    assert [(r.doc_id, r.frame, r.start_cs) for r in rows] == [(1, 0, 0), (1, 1, 5), (2, None, None), (3, None, None)]
    assert bytes(rows[1].rgb) == bytes([*B, *G]) and sum(rows[1].histogram) == 2 and rows[3].error == "not a GIF"
    assert gif.frames(media.limit(0)).count() == 0
