"""Whole batches of texts as flat arrays: words, word hashes and shingles without a loop over words.

Used inside Arrow tasks.  A batch is cut into pieces of bounded size first, so that memory follows
``PIECE_BYTES`` or the longest single text, not the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

#: Separators of words: space and the bytes 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(int(_random.integers(1 << 40, 1 << 62)) | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of them; grown by doubling and kept by the worker."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        kept = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size > 8 * PIECE_BYTES:
            return kept
        _powers[size] = kept
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts hold at most ``limit`` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    lengths = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64))
    at, ends = 0, np.cumsum(lengths)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class Words:
    """Words of a batch: ``start``, ``end`` (bytes in the batch), ``row``, and ``first`` (index of each row's first word)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self.rows = raw, offsets, len(offsets) - 1
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~SEPARATOR[raw]
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        if len(raw):
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < len(raw))]
            opens[edge] = inside[1:-1][edge]
            closes[edge - 1] = inside[1:-1][edge - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of every word."""
        up, down = powers(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(BYTE_CODE[LOWER[self.raw] if lower else self.raw] * up[: len(self.raw)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def shingles(words: Words, codes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a shorter text that has words is one run of all of them."""
    rows, first, count = words.rows, words.first, words.count
    padded = np.concatenate([codes, np.zeros(size, np.uint64)])
    value = np.zeros(len(codes), np.uint64)
    for k in range(size):
        value = value * BASE + padded[k : k + len(codes)]
    left = first[1:][words.row] - np.arange(len(codes))
    whole = left >= size
    row, out = words.row[whole], mix(value[whole])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            extra = np.where(has, extra * BASE + padded[np.minimum(first[short] + k, len(codes))], extra)
        row, out = np.concatenate([row, short]), np.concatenate([out, mix(extra ^ (count[short].astype(np.uint64) << np.uint64(60)))])
    return row, out
