"""Words and word hashes of whole Arrow batches of text, in numpy.

A batch is cut into slices of bounded size by whole texts, so memory does not follow the number of
rows in a batch. Word borders and hashes are found for all texts of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    out = values ^ (values >> np.uint64(31))
    out *= np.uint64(0x7FB5D329728EA185)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x81DADEF4BC2DD44D)
    out ^= out >> np.uint64(33)
    return out


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

SPACED = np.ones(256, dtype=bool)  # words [^\x20\x09-\x0D]+
SPACED[[0x20, *range(0x09, 0x0E)]] = False
LETTERED = np.zeros(256, dtype=bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
LETTERED[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Words:
    """Words of the texts of one slice. Text ``i`` has the words ``first[i]:first[i + 1]``."""

    rows: slice
    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def texts(self) -> int:
        return len(self.first) - 1


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole texts; a run has ``limit`` bytes or a single text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield slice(at, to), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def _powers(base: int, count: int) -> np.ndarray:
    power = np.full(count, base, dtype=np.uint64)
    power[:1] = 1
    return np.multiply.accumulate(power, out=power)


def words_of(rows: slice, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, lower: bool = True) -> Words:
    """Words of one slice, A-Z lower-cased. The hash of a word depends on its bytes alone."""
    if lower:
        data = _LOWER[data]
    size = len(data)
    inside = np.zeros(size + 1, dtype=bool)
    inside[:size] = letters[data]
    begins = inside[:size].copy()
    begins[1:] &= ~inside[:size - 1] if size else inside[:0]
    at = offsets[:-1][offsets[:-1] < size]
    begins[at] = inside[at]  # a word ends with its text
    starts = np.flatnonzero(begins)
    stops = inside[:size].copy()
    stops[:size - 1] &= ~inside[1:size]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[last]
    ends = np.flatnonzero(stops) + 1
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_ODD, size), out=sums[1:])
    # the sum over a word carries the power of its place; the inverse power takes it out
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, size)[starts] + (ends - starts).astype(np.uint64))
    return Words(rows, hashes, np.searchsorted(starts, offsets), starts, ends, data)


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words."""
    count = max(0, len(hashes) - length + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(length):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k:k + count]
    return mix(out)
