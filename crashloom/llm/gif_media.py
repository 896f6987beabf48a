"""Media columns: GIF files with timed frames, decoded to pixels and colour histograms.

The decoder reads the general format: global and local palettes, code streams with
growing code widths and clear codes, interlacing, transparency, delays and the disposal
methods. A code stream is decoded a segment (from clear code to clear code) at a time: code widths depend
only on the place in the segment, so numpy reads its codes at once, and a table gives their strings. The encoder looks for the longest known string in a dictionary, as the
format means it, and clears the table when it is full.

:func:`store` writes each document's bytes losslessly as the samples of gray frames of 64
columns and at most 1024 rows, reads the file back and derives features.

Defined results: a null text is an empty one, whose payload is 64 zero bytes. Equal texts
have equal files and features. A malformed file raises ValueError in
:func:`decode`; :func:`frames` gives it one row with ``error`` set.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

WIDTH, ROWS, DELAY = 64, 1024, 4
BINS = 8
_GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


@lru_cache(maxsize=None)
def _widths(code_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the n-th code behind a clear code, and where it begins; later codes have 12 bits, as those with a full table do."""
    nth = np.arange(4096)
    entries = np.minimum((1 << code_size) + 2 + np.maximum(nth - 1, 0), 4095)  # in the table when the n-th code is read
    widths = np.minimum(np.maximum(code_size + 1, np.floor(np.log2(entries)).astype(np.int64) + 1), 12)
    return widths, np.append(0, np.cumsum(widths))


def lzw_encode(data: bytes, code_size: int = 8) -> bytes:
    """The code stream of samples below 2**code_size."""
    clear = 1 << code_size
    codes, ends = [clear], []  # all codes, and behind which of them the table starts anew
    table, entry, now = {}, clear + 2, -1
    for b in data:
        key = now << 8 | b
        got = table.get(key)
        if got is not None:
            now = got
        elif now < 0:
            now = b
        else:
            codes.append(now)
            if entry < 4096:
                table[key] = entry
                entry += 1
            else:
                ends.append(len(codes))
                codes.append(clear)
                table, entry = {}, clear + 2
            now = b
    if now >= 0:
        codes.append(now)
    codes.append(clear + 1)
    of = _widths(code_size)[0]
    widths = np.concatenate([[code_size + 1], *(of[: b - a] for a, b in zip([0, *ends], [*ends, len(codes) - 1]))])
    bits = (np.array(codes, np.uint16)[:, None] >> np.arange(12, dtype=np.uint16)).astype(np.uint8) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, code_size: int, most: int) -> np.ndarray:
    """The indices of a code stream; decoding stops at the end code or after ``most`` indices."""
    clear, bits = 1 << code_size, 8 * len(stream)
    raw = np.zeros(len(stream) + 3, np.uint32)
    raw[: len(stream)] = np.frombuffer(stream, np.uint8)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16  # the 24 bits from each byte on
    widths, offsets = _widths(code_size)
    full, late = np.full(len(widths), 12), np.arange(len(offsets)) * 12
    out, at, total = [], 0, 0
    while at + code_size + 1 <= bits and total < most:
        table, w, places, last, before = None, widths, offsets, clear + 1, b""
        while total < most:
            n = min(int(np.searchsorted(places, bits - at, side="right")) - 1, len(w))
            where = at + places[:n]
            codes = words[where >> 3] >> (where & 7).astype(np.uint32) & ((1 << w[:n]) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            k = int(stop[0]) if len(stop) else n
            if k:
                table = _SINGLE[code_size].copy() if table is None else table
                before, m = _strings(codes[:k].tolist(), table, before, out)
                total += m
            if len(stop):
                last = codes[k]
                at += int(places[k + 1])
                break
            at += int(places[n])
            if n < len(w):
                break
            w, places = full, late
        if last == clear + 1:
            break
    return np.frombuffer(b"".join(out)[:most], np.uint8)


#: The table behind a clear code: the single samples, and the places of the clear and the end code.
_SINGLE = {size: [bytes([i]) for i in range(1 << size)] + [b"", b""] for size in range(2, 9)}


def _strings(codes: list[int], table: list[bytes], before: bytes, out: list[bytes]) -> tuple[bytes, int]:
    """Appends the strings of ``codes`` to ``out``, and new ones to ``table``; the last string and the number of samples."""
    begin, size, at, put, add = len(out), len(table), 0, out.append, table.append
    if not before:
        before, at = table[codes[0]] if codes[0] < size else b"", 1
        put(before)
    if len(before) == 0:
        raise ValueError("a code stream names a string that isn't in the table")
    free = at + 4096 - size
    for c in codes[at:free]:
        if c < size:
            now = table[c]
        elif c == size:
            now = before + before[:1]
        else:
            raise ValueError("a code stream names a string that isn't in the table")
        put(now)
        add(before + now[:1])
        size += 1
        before = now
    # with a full table nothing is new
    out += [table[c] for c in codes[max(at, free) :]]
    return out[-1], sum(map(len, out[begin:]))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold ``payload`` (a multiple of ``width`` bytes) as gray samples."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    data = np.frombuffer(payload, np.uint8)
    height = min(rows, len(data) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GRAY.tobytes()]
    for i in range(0, len(data), width * rows):
        part = data[i : i + width * rows]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part.tobytes()))]
    return b"".join([*out, b"\x3b"])


class Frame:
    """One decoded frame: its own indices and area, the palette, its delay, and how the canvas looks with it."""

    def __init__(self, area, indices, palette, transparent, delay, disposal):
        self.area, self.indices, self.palette, self.transparent, self.delay, self.disposal = area, indices, palette, transparent, delay, disposal
        self.canvas: np.ndarray | None = None


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while True:
        if at >= len(data):
            raise ValueError("the file ends within a block")
        n = data[at]
        if not n:
            return b"".join(out), at + 1
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and the frames in order, each with the composed RGBA canvas."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, world = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        world = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    frames, transparent, delay, disposal = [], None, 0, 0
    while True:
        if at >= len(data):
            raise ValueError("the file has no end mark")
        kind, at = data[at], at + 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at]
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                transparent, disposal = index if packed & 1 else None, packed >> 2 & 7
        elif kind == 0x2C:
            x, y, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at, palette = at + 9, world
            if packed & 0x80:
                n = 2 << (packed & 7)
                palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            if palette is None or x + w > width or y + h > height:
                raise ValueError("a frame without palette or outside the canvas")
            code_size = data[at]
            if not 2 <= code_size <= 8:
                raise ValueError("a code size that no palette has")
            stream, at = _sub_blocks(data, at + 1)
            indices = lzw_decode(stream, code_size, w * h)
            if len(indices) != w * h or (len(indices) and indices.max() >= len(palette)):
                raise ValueError("a frame with missing or unknown samples")
            indices = indices.reshape(h, w)
            if packed & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(indices)
                plain[order] = indices
                indices = plain
            frames.append(Frame((x, y, w, h), indices, palette, transparent, delay, disposal))
            transparent, delay, disposal = None, 0, 0
        else:
            raise ValueError("an unknown block")
    _compose(width, height, frames)
    return width, height, frames


def _compose(width: int, height: int, frames: list[Frame]) -> None:
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        x, y, w, h = f.area
        before = canvas.copy() if f.disposal == 3 else None
        shown = canvas.copy() if len(frames) > 1 else canvas
        colours = np.column_stack([f.palette, np.full(len(f.palette), 255, np.uint8)]).take(f.indices, axis=0)
        part = shown[y : y + h, x : x + w]
        if f.transparent is None:
            part[:] = colours
        else:
            solid = f.indices != f.transparent
            part[solid] = colours[solid]
        f.canvas = shown
        if f.disposal == 2:
            canvas = shown.copy()
            canvas[y : y + h, x : x + w] = 0
        else:
            canvas = before if f.disposal == 3 else shown


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(3, bins) counts of the red, green and blue values of the pixels that aren't transparent."""
    clear = canvas[..., 3] == 0
    solid = canvas[~clear] if clear.any() else canvas.reshape(-1, 4)
    fold = np.arange(256) * bins >> 8
    return np.array([np.bincount(fold, np.bincount(solid[:, k], minlength=256), bins) for k in range(3)]).astype(np.int64)


FRAMES = "frame int, delay_ms int, disposal int, width int, height int, pixels binary, red array<long>, green array<long>, blue array<long>, error string"


def frames(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each frame of each file: its time, composed RGBA pixels and colour histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for k, raw in zip(x.column(0), x.column(1).to_pylist()):
                try:
                    w, h, got = decode(raw or b"")
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((k, None, None, None, None, None, None, None, None, None, str(e)))
                    continue
                for i, f in enumerate(got):
                    r, g, b = histogram(f.canvas).tolist()
                    rows.append((k, i, f.delay * 10, f.disposal, w, h, f.canvas.tobytes(), r, g, b, None))
            for i in range(0, len(rows), 16):
                part = list(zip(*rows[i : i + 16]))
                kinds = [None, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
                names = [key, "frame", "delay_ms", "disposal", "width", "height", "pixels", "red", "green", "blue", "error"]
                first = pa.array([v.as_py() for v in part[0]], x.column(0).type)
                yield pa.RecordBatch.from_arrays([first, *(pa.array(c, t) for c, t in zip(part[1:], kinds[1:]))], names)

    rows = files.select(key, F.col(media).cast("binary").alias("_media"))
    return in_arrow(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {FRAMES}")


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    n = len(raw)
    return raw + bytes(max(WIDTH, -(-n // WIDTH) * WIDTH) - n), n


STORED = "n_bytes long, media binary"
DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row: its text as a GIF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [payload(t) for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([encode(p) for p, _ in got], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return in_arrow(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, {STORED}")


def digest(media: bytes) -> tuple[int, str, int, int, str, str]:
    """What is read back from a file that :func:`store` made."""
    w, h, got = decode(media)
    back = b"".join(f.palette[:, 0].take(f.indices).tobytes() for f in got)
    bins = sum(histogram(f.canvas)[0] for f in got)
    feature = f"{w}x{h};frames={len(got)};ms={sum(f.delay for f in got) * 10};hist=" + ",".join(map(str, bins.tolist()))
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, ...digests) for each file of :func:`store`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cols = list(zip(*(digest(m) for m in x.column(2).to_pylist()))) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_bytes", *names])

    return in_arrow(stored, run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {DIGESTS}")
