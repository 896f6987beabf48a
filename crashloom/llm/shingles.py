"""Vectorised word-shingle hashing for Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 2**63, 1 << 12, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)
#: Bytes of text that are hashed at a time, each of which takes some 80 bytes meanwhile; a longer text is hashed alone.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space words of the texts raw[at[i]:at[i+1]], and where each text's words begin."""
    raw = _LOWER[raw]
    space = _SPACE[raw]
    begins = np.empty(len(raw), dtype=bool)
    begins[:1] = True
    begins[1:] = space[:-1]
    begins[at[:-1][at[:-1] < len(raw)]] = True
    begins &= ~space
    keep = np.flatnonzero(~space)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, _U), np.zeros(len(at), np.int64)
    first = np.flatnonzero(begins[keep])
    sizes = np.diff(np.append(first, len(keep)))
    place = np.arange(len(keep)) - np.repeat(first, sizes)
    # a place beyond the table also enters through its quotient, so that long words don't repeat
    parts = _BYTE[raw[keep]] * (_PLACE[place & 4095] + (place >> 12).astype(_U) * _U(0x9E3779B97F4A7C15))
    words = mix(np.add.reduceat(mix(parts), first) + sizes.astype(_U) * _U(0xD6E8FEB86659FD93))
    return words, np.searchsorted(starts, at)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows``, so that what is made of one stays small."""
    for x in batches:
        for i in range(0, x.num_rows, rows):
            yield x.slice(i, rows)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (int64) of its word shingles.

    A text of fewer words is one shingle; a null text and one without words has none.
    """
    data = texts.cast(pa.large_string())
    size = np.diff(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]) if len(data) else np.empty(0, np.int64)
    i = 0
    while i < len(data):
        j, total = i + 1, size[i]
        while j < len(data) and total + size[j] <= CHUNK:
            total += size[j]
            j += 1
        yield from _chunk(data.slice(i, j - i), width)
        i = j


def _chunk(data: pa.Array, width: int) -> Iterator[np.ndarray]:
    off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]] if data.buffers()[2] is not None else np.empty(0, np.uint8)
    words, at = word_hashes(raw, off - off[0])
    n = len(words)
    acc = np.zeros(max(0, n - width + 1), _U)
    for k in range(width):
        acc += words[k : k + len(acc)] * _STEP[k]
    acc = mix(acc)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            yield np.unique(acc[a : b - width + 1]).view(np.int64) if b - a > width else acc[a : a + 1].view(np.int64)
        elif b > a:
            yield mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + _U(int(b - a) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)
        else:
            yield np.empty(0, np.int64)
