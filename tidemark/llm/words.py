"""Words, word hashes and shingles of whole Arrow text columns, by numpy.

A word is a run of bytes other than space and the controls 9 to 13; as these are ASCII,
the rule is the same on UTF-8 bytes and on code points.  Hashes have 64 bits and depend
on the bytes alone, so they are equal in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
BLOCK_BYTES = 1 << 20  # texts are worked on in blocks of about this size
_powers = {"n": -1}


class TextBlock(NamedTuple):
    """Consecutive rows of a text column: their bytes, and where each row's begin and end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """The column in blocks of whole rows; a null is an empty text, a long text its own block."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        upto = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        upto = min(max(upto, row + 1), len(column))
        own = offsets[row : upto + 1]
        yield TextBlock(row, data[own[0] : own[-1]], own - own[0])
        row = upto


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, from differences of one running polynomial sum."""
    if _powers["n"] < len(data):
        n = max(len(data), 2 * BLOCK_BYTES)
        _powers["n"] = n
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers["up"][: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers["down"][start] + (end - start).astype(np.uint64))


LONGEST_TABLED = 64
# One number for each place and byte: sums of them have no structure that texts could meet.
_TABLE = mix(np.arange(1, LONGEST_TABLED * 256 + 1, dtype=np.uint64) * np.uint64(BASE))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span that stands for its bytes: tabulated by place, of long spans a digest."""
    size = end - start
    out = np.zeros(len(start), dtype=np.uint64)
    short = np.flatnonzero((size <= LONGEST_TABLED) & (size > 0))
    if len(short):
        lengths = size[short]
        first = np.cumsum(lengths) - lengths
        place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
        byte = data[place + np.repeat(start[short], lengths)]
        out[short] = mix(np.add.reduceat(_TABLE[place * 256 + byte], first))
    for i in np.flatnonzero(size > LONGEST_TABLED).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of every word."""
    n = len(block.data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~is_space(block.data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    rows = np.searchsorted(block.offsets, starts, side="right") - 1
    return rows, starts, ends


def words(block: TextBlock) -> Words:
    rows, start, end = word_spans(block)
    return Words(rows, start, end, word_hashes(block.data, start, end))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each window of ``size`` consecutive words of one row."""
    n = len(found.row) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        value = value * np.uint64(BASE) + found.hash[k : k + n]
    whole = found.row[:n] == found.row[size - 1 :]
    return found.row[:n][whole], mix(value[whole])
