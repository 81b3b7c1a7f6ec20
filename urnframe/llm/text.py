"""Words and their hashes for Arrow batches, a few array passes per batch.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``. Its hash is a polynomial over the bytes
modulo 2**64, finished by a mixer, so any run of bytes is hashed from two prefix sums. Two
different words share a hash about once in 2**64 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP = U64(0xD1342543DE82EF95)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = BASE if kind == "up" else pow(BASE, -1, 2**64)
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(batch: pa.RecordBatch, column: str, budget: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``budget`` bytes of text; a longer text goes alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > budget:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if len(sizes) > first:
        yield batch.slice(first)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins and ends in them (null: empty)."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    low = bounds[0] if len(bounds) else 0
    size = int(bounds[-1] - low)
    body = np.frombuffer(data, np.uint8, size, int(low)) if size else np.zeros(0, np.uint8)
    return body, bounds - low


class Words:
    """The words of the rows of a text column, in order: bytes, places, rows and hashes."""

    def __init__(self, column: pa.Array, lower: bool = True):
        data, self.bounds = raw(column)
        if lower:
            data = data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)
        self.data = data
        space = (data == 32) | ((data >= 9) & (data <= 13))
        first = ~space
        first[1:] &= space[:-1]
        begins = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
        first[begins] = ~space[begins]
        last = ~space
        last[:-1] &= space[1:]
        finals = begins[1:] - 1
        last[finals] = ~space[finals]
        if len(data):
            last[-1] = ~space[-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power("up", n), out=self.sums[1:])
        self.row = np.searchsorted(self.bounds, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(self.bounds) - 1).astype(np.int64)
        self.key = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of runs of bytes, by their content and length."""
        if not len(start):
            return np.zeros(0, np.uint64)
        down = _power("down", int(start.max()) + 1)
        body = (self.sums[end] - self.sums[start]) * down[start]
        return mix(body + (end - start).astype(np.uint64) * STEP + U64(salt))

    def grams(self, start: np.ndarray, end: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """All runs of ``n`` bytes inside the given runs: the run's number and the hash."""
        each = np.maximum(end - start - n + 1, 0)
        of = np.repeat(np.arange(len(start)), each)
        at = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + start[of]
        return of, self.span(at, at + n, salt)


def shingles(keys: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes, in order; ``len(keys) - n + 1`` values."""
    size = len(keys) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    factor = U64(pow(BASE, n, 2**64))
    total = np.zeros(size, np.uint64)
    step = U64(1)
    for i in range(n):
        total += keys[i : i + size] * step
        step = U64(int(step) * (BASE | 1) % 2**64)
    return mix(total + factor)


def text_column(values: list[str] | pa.Array) -> pa.Array:
    return pa.array(values, pa.string()) if isinstance(values, list) else values
