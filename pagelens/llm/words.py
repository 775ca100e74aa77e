"""Vectorised words, hashes and n-grams over Arrow string columns.

A block of texts is one byte array with offsets. Words are maximal runs of bytes of a
class given by a 256-entry table, so UTF-8 letters beyond ASCII stay whole. A word's
hash is a polynomial of its bytes modulo 2**64, taken from prefix sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, GRAM = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BLOCK_BYTES = 1 << 19
#: Powers up to this one are kept between blocks; those for longer texts are made anew.
KEPT_POWERS = 1 << 21

#: Bytes of words between ASCII white space (U+0020, U+0009 to U+000D).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = ((n + 1) >> 18) + 1 << 18
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, U)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        have = both[0], both[1]
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a block holds about `limit` bytes of the column, or one longer text whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = bytes_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a block: start and end bytes, the row of each, hashes, and first[i] .. first[i + 1] for row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data, n = data, len(offsets) - 1
        if len(data) == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(n + 1, np.int64)
        else:
            inside = kind[data]
            begins, ends = inside.copy(), inside.copy()
            cuts = offsets[(offsets > 0) & (offsets < len(data))]
            before = np.empty_like(inside)
            before[0], before[1:] = False, inside[:-1]
            before[cuts] = False
            begins &= ~before
            after = np.empty_like(inside)
            after[-1], after[:-1] = False, inside[1:]
            after[cuts - 1] = False
            ends &= ~after
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(n), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        if len(self) == 0:
            return np.zeros(0, U)
        up, down = powers(BASE, len(self.data))
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U) * U(GRAM))


def sums_of(values: np.ndarray, base: int = GRAM) -> np.ndarray:
    """Prefix sums from which spans_of() takes the hash of any run of values."""
    up, _ = powers(base, len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def spans_of(sums: np.ndarray, at: np.ndarray, to: np.ndarray, base: int = GRAM) -> np.ndarray:
    _, down = powers(base, len(sums))
    return mix((sums[to] - sums[at]) * down[at] + (to - at).astype(U) * U(BASE))


def take_spans(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] for all i, joined."""
    total = int(length.sum())
    if total == 0:
        return values[:0]
    before = np.cumsum(length) - length
    return values[np.repeat(start - before, length) + np.arange(total)]
