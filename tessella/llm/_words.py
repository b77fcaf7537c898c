"""Words of Arrow text columns as numpy arrays: spans and 64-bit hashes, for whole batches at once.

A batch's texts lie in one byte buffer. Everything here works on that buffer, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is still taken whole.
SLICE_BYTES = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes other than letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
_LOWER_BYTE = _LOWER.astype(np.uint8)
_CODE = np.random.Generator(np.random.PCG64(20_240_229)).integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_CODE_LOWER = _CODE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        for s in steps:
            s[0] = 1
        _powers = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def row_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each piece have at most ``limit`` bytes or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each row's offsets in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


@dataclass
class Spans:
    """Byte spans of the runs between separators. Row r owns ``starts[rows[r]:rows[r + 1]]``."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> Spans:
    """Maximal runs of bytes that are no separators; a run never goes over the end of a row."""
    if not len(data):
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = inside[begin]
    last[end] = inside[end]
    starts = np.flatnonzero(first)
    return Spans(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes (``lower``: with A-Z as a-z); equal bytes give equal hashes everywhere."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_CODE_LOWER if lower else _CODE)[data] * up[:-1], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(values: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` values that stays within a row, index of its first value)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * _BASE + values[j : j + n]
    at = np.arange(n)
    room = np.repeat(rows[1:], np.diff(rows))[:n] - at
    at = at[room >= width]
    return mix(total[at]), at


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between each two neighbouring offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., ``count[0]`` of them, then the same from first[1] on."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` is, byte for byte, the span of ``other`` beside it. No span may be empty."""
    same = ends - starts == end - first
    at = np.flatnonzero(same)
    if len(at):
        size = (ends - starts)[at]
        equal = data[runs(starts[at], size)] == other[runs(first[at], size)]
        same[at] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return same


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER_BYTE[data]


class HashIndex:
    """64-bit key -> position, looked up for whole arrays (open addressing, a few probes)."""

    def __init__(self, keys: np.ndarray):
        self.size = 1 << max(4, int(2 * len(keys)).bit_length() + 1)
        self.keys, self.where = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        keys = keys.astype(np.uint64)
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.where[slot] < 0
            slot, cand = slot[free], left[free]
            self.where[slot] = cand  # where several meet, the last stays
            self.keys[slot] = keys[self.where[slot]]
            done = np.zeros(len(keys), bool)
            done[self.where[slot]] = True
            left = left[~done[left]]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys + np.uint64(probe)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - (self.size.bit_length() - 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for probe in range(self.probes):
            slot = self._slot(keys[left], probe)
            where = self.where[slot]
            hit = (where >= 0) & (self.keys[slot] == keys[left])
            out[left[hit]] = where[hit]
            left = left[~hit & (where >= 0)]
            if not len(left):
                break
        return out
