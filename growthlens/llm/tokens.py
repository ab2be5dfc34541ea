"""Words of a batch of texts as numpy arrays: offsets and 64-bit hashes, without one Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time, so that memory does not follow the size of a batch.
BLOCK_BYTES = 2 << 20

_RANDOM = np.random.default_rng(20260)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_NEAR_POWERS = _powers(_BASE, _FAR)
with np.errstate(over="ignore"):
    _FAR_BASE = _NEAR_POWERS[-1] * _BASE
_INVERSE_POWERS = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), _FAR)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes inside words that are separated by white space of ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of letters: ASCII letters and every byte of a character outside ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers are kept and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not every C library has it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary()).fill_null(b"") if binary else column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with few bytes of text each; a longer text is a run of its own."""
    _, offsets = text_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes for which `inside` holds; runs end with their text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = inside[data]
    begin, end = on.copy(), on.copy()
    begin[1:] &= ~on[:-1]
    end[:-1] &= ~on[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = on[edge]
    end[edge - 1] = on[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; spans do not overlap, but may come in any order.

    It is a polynomial in an odd base modulo 2^64. Running sums over a stretch of bytes give those of its spans: their
    difference, divided by the power at which the span begins.
    """
    if (begin[1:] < begin[:-1]).any():
        order = np.argsort(begin)
        out = np.empty(len(begin), dtype=np.uint64)
        out[order] = span_hashes(data, begin[order], end[order])
        return out
    out = np.empty(len(begin), dtype=np.uint64)
    first = 0
    while first < len(begin):
        start = begin[first]
        last = int(np.searchsorted(end, start + _FAR - 1, side="right"))
        if last <= first:
            out[first] = _long_hash(data[start : end[first]])
            first += 1
            continue
        sums = np.zeros(end[last - 1] - start + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[start : end[last - 1]]] * _NEAR_POWERS[: len(sums) - 1], out=sums[1:])
        a = begin[first:last] - start
        out[first:last] = (sums[end[first:last] - start] - sums[a]) * _INVERSE_POWERS[a]
        first = last
    return mix(out ^ (end - begin).astype(np.uint64))


def _long_hash(data: np.ndarray) -> np.uint64:
    """The sum of a span that is longer than the tables of powers."""
    total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for i in range(0, len(data), _FAR):
        part = data[i : i + _FAR]
        total += power * np.sum(_BYTE[part] * _NEAR_POWERS[: len(part)])
        power *= _FAR_BASE
    return total[0]


def counts_per_text(begin: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n + 1 positions at which each text's spans begin in the list of all spans."""
    return np.searchsorted(begin, offsets)


class HashIndex:
    """Row numbers of known hashes: a table by the upper bits screens, a sorted list decides."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.shift = np.uint64(64 - bits)
        self.screen = np.zeros(1 << bits, dtype=bool)
        self.screen[self.keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row number of each hash, -1 where it is unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.keys):
            likely = np.flatnonzero(self.screen[hashes >> self.shift])
            some = hashes[likely]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            hit = self.keys[at] == some
            out[likely[hit]] = self.order[at[hit]]
        return out
