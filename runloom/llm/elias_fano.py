"""Monotone sequences in Elias-Fano code, read through numpy from bytes that may be memory-mapped.

A value is cut into low bits, packed side by side, and a high part, written in unary: for each value a one, for each
step of the high part a zero. Ones and zeros are found by counts before each 64 bits.
"""

from __future__ import annotations

import json
import struct

import numpy as np

#: So many values are looked up at once, few enough to stay in the processor's cache.
_CHUNK = 1 << 15
#: SELECT_IN_BYTE[b, r]: the place of the r-th one of byte b.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
SELECT_IN_BYTE = np.array([[*np.flatnonzero(row), *[0] * (8 - row.sum())] for row in _BITS], np.uint8)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a sequence of non-decreasing values below `universe`."""
    n = len(values)
    low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    length = n + (int(universe) >> low_bits) + 1
    words = -(-length // 64)
    bits = np.zeros(words * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").view("<u8")
    samples = np.append(0, np.cumsum(np.bitwise_count(upper).astype(np.int64)))
    samples = samples.astype("<i4" if length < 1 << 31 else "<i8")
    lows = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lower = np.append(np.packbits(lows.ravel(), bitorder="little"), np.zeros(8, np.uint8))
    return {"meta": np.array([n, low_bits], "<i8"), "upper": upper, "samples": samples, "lower": lower}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in arrays["meta"])
        self.upper, self.ones, self.lower = arrays["upper"], arrays["samples"], arrays["lower"]
        self.zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones

    def _select(self, rank: np.ndarray, samples: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Place of the bit with this rank among the ones of upper ^ flip."""
        word = np.searchsorted(samples, rank, side="right") - 1
        left = rank - samples[word]
        octets = (self.upper[word] ^ flip)[:, None].view(np.uint8)
        octet, left = _step(np.bitwise_count(octets), left)
        return word * 64 + octet * 8 + SELECT_IN_BYTE[octets[np.arange(len(rank)), octet], left]

    def low(self, at: np.ndarray) -> np.ndarray:
        """Low bits of the values at these places."""
        first = at * self.low_bits
        octets = self.lower[(first >> 3)[:, None] + np.arange(8)]
        word = np.ascontiguousarray(octets).view("<u8").ravel()
        return (word >> (first & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        high = self._select(at, self.ones, np.uint64(0)) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low(at)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place, and the one after the last, of the values with this high part."""
        flip = np.uint64(0xFFFFFFFFFFFFFFFF)
        ends = self._select(high, self.zeros, flip) - high
        starts = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, flip) - high + 1, 0)
        return starts, ends

    def find(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each value within [start, end), or -1: the successor of a value there, if it equals it."""
        parts = [slice(a, a + _CHUNK) for a in range(0, len(values), _CHUNK)]
        return np.concatenate([self._find(values[p], start[p], end[p]) for p in parts] or [np.array([], np.int64)])

    def _find(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low = values & np.uint64((1 << self.low_bits) - 1)
        first, last = self.bucket((values >> np.uint64(self.low_bits)).astype(np.int64))
        at, last = np.maximum(first, start), np.minimum(last, end)
        # The low bits are sorted within a bucket: halve until the first one that is not smaller is left.
        below, left = np.maximum(last - at, 0), np.flatnonzero(at < last)
        while len(left):
            half = below[left] >> 1
            middle = at[left] + half
            smaller = self.low(middle) < low[left]
            at[left] = np.where(smaller, middle + 1, at[left])
            below[left] = np.where(smaller, below[left] - half - 1, half)
            left = left[below[left] > 0]
        inside = np.flatnonzero(at < last)
        hit = inside[self.low(at[inside]) == low[inside]]
        found = np.full(len(values), -1, np.int64)
        found[hit] = at[hit]
        return found


def _step(counts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column in which the running count passes the rank, and the rank within it."""
    totals = np.cumsum(counts, 1, dtype=np.int64)
    column = (totals <= rank[:, None]).sum(1)
    rows = np.arange(len(rank))
    return column, rank - (totals[rows, column] - counts[rows, column])


def to_bytes(parts: dict[str, np.ndarray]) -> bytes:
    """Named arrays behind a directory, each on a multiple of 8 bytes."""
    listed, at = {}, 0
    for name, array in parts.items():
        listed[name] = (array.dtype.str, at, len(array))
        at += array.nbytes + -array.nbytes % 8
    head = json.dumps(listed).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([struct.pack("<Q", len(head)), head, *[a.tobytes() + b"\0" * (-a.nbytes % 8) for a in parts.values()]])


def from_buffer(buffer) -> dict[str, np.ndarray]:
    """The arrays as views of the buffer; nothing is copied."""
    (size,) = struct.unpack("<Q", bytes(buffer[:8]))
    listed = json.loads(bytes(buffer[8 : 8 + size]))
    return {name: np.frombuffer(buffer, kind, count, 8 + size + at) for name, (kind, at, count) in listed.items()}


def nested(parts: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {name.removeprefix(prefix): a for name, a in parts.items() if name.startswith(prefix)}
