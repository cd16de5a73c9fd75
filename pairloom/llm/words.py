"""Words of many texts at once: boundaries and 64-bit hashes in numpy, straight from Arrow's UTF-8 buffer.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D. No byte of a longer UTF-8 sequence is one of
these, so bytes give the same words as code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # texts are handled in blocks of about this many bytes: it bounds memory, not results

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODES[SEPARATOR] = 0
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = LOWER_CODES[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
CHAIN = np.uint64(0xD6E8FEB86659FD93)
_unchain = np.uint64(pow(int(CHAIN), -1, 1 << 64))
_powers = {name: np.ones(1, np.uint64) for name in ("up", "down", "chain", "unchain")}


def _power_table(name: str, factor: np.uint64, n: int) -> np.ndarray:
    table = _powers[name]
    while len(table) < n:
        step = np.uint64(pow(int(factor), len(table), 1 << 64))
        table = np.concatenate([table, table * step])
    _powers[name] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 bounds. A null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, bounds) of consecutive whole texts with about ``size`` bytes together."""
    if not len(column):
        return
    data, bounds = utf8(column)
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_spans(
    data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte and end byte of every word, and the n + 1 bounds of the texts in words."""
    inside = ~separator[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A hash of the bytes of each span. Spans ascend and do not overlap; bytes between them must code as 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = codes[data] * _power_table("up", BASE, len(data))[: len(data)]
    sums = np.add.reduceat(values, starts) * _power_table("down", _inverse, len(data))[starts]
    return mix(sums + (ends - starts).astype(np.uint64))


def hashed_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the n + 1 bounds of the texts in words. ``lower`` folds A to Z."""
    starts, ends, counts = word_spans(data, bounds)
    return span_hashes(data, starts, ends, LOWER_CODES if lower else BYTE_CODES), counts


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive numbers, whatever text they are in; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > 8:  # differences of running sums give the same numbers
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _power_table("chain", CHAIN, len(h))[: len(h)], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * _power_table("unchain", _unchain, len(h))[:n])
    total, factor = np.zeros(n, np.uint64), 1
    for i in range(k):
        total += h[i : i + n] * np.uint64(factor)
        factor = factor * int(CHAIN) % (1 << 64)
    return mix(total)


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each item, the text it is in."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
