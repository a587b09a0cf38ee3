"""Numpy helpers over the texts of an Arrow batch, all rows of a slice at once.

A slice is one byte array with row offsets; words, k-grams and windows are index arrays over it. Nothing here
knows Spark; the operators call these helpers inside their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Windows whose least k-gram is sought at once; positions take this many bits of the sort key, whatever the text.
BLOCK_BITS = 22

_SPACES = [0x20, *range(0x09, 0x0E)]
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[_SPACES] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, all beyond ASCII.
LETTERED = np.zeros(256, dtype=bool)
LETTERED[0x30:0x3A] = LETTERED[0x61:0x7B] = LETTERED[0x80:] = True
#: Lower-cases A-Z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_ODD_A, _ODD_B, _ALL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
_A, _B = np.uint64(_ODD_A), np.uint64(_ODD_B)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each row the index of its first word (one entry more)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    flags = is_word[data]
    start, end = flags.copy(), flags.copy()
    start[1:] &= ~flags[:-1]
    end[:-1] &= ~flags[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = flags[inner]
    end[inner - 1] = flags[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing one-to-one map of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; beyond the end come zeros."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(shape=(len(data),), dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * _A + np.uint64((seed + 1) * _ODD_B & _ALL))
    if not len(starts):
        return out
    eight = chunks8(data)
    live = np.arange(len(starts))
    at = 0
    while True:
        live = live[lengths[live] > at]
        if not len(live):
            return out
        part = eight[starts[live] + at].copy()
        rest = lengths[live] - at
        short = rest < 8
        part[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[live] = mix(out[live] * _A + part)
        at += 8


def _joined(left: np.ndarray, right: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = left * _B
    x += right
    x += salt
    x ^= x >> np.uint64(32)
    x *= _A
    x ^= x >> np.uint64(29)
    return x


def run_hashes(symbols: np.ndarray, length: int, seed: int = 0, unit: int = 1) -> np.ndarray:
    """A hash of every run of ``length`` places, by doubling; one entry per start, none if there are too few.

    ``symbols`` holds a number for the ``unit`` places from each place on, so ``length`` must be a multiple of it.
    """
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    salt = np.uint64((2 * seed + 1) * _ODD_A & _ALL)
    power, level, done, out = unit, symbols, 0, None
    while True:
        if length & power:
            part = level[done : done + n]
            out = mix(part) if out is None else _joined(out, part, salt)
            done += power
        power *= 2
        if power > length:
            return out
        half = power // 2
        level = _joined(level[:-half], level[half:], salt)


def least_positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the position of the least one, the first of equal ones.

    Which position is taken depends on the window's own hashes alone, so equal windows take the same place.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    block = (1 << BLOCK_BITS) - width
    low = np.uint64((1 << BLOCK_BITS) - 1)
    for first in range(0, n, block):
        part = hashes[first : min(n, first + block) + width - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        out[first : first + len(key)] = (key & low).astype(np.int64) + first
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a span."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of many ranges, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)
