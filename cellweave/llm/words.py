"""Vectorised word kernel shared by the corpus operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, taken from the
UTF-8 bytes of a text and left unchanged.  All work is done with NumPy over the
concatenated bytes of a slice of documents, so that no Python code runs per word.
Hashes are 64 bits wide and depend on the words only: every executor, run and
batch layout gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that one slice holds, unless a single document is longer, and rows.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


@dataclass
class Words:
    """The words of a slice: word i of document j is at first[j] + i."""

    data: np.ndarray  # bytes, eight zero bytes longer than the texts
    starts: np.ndarray  # byte at which each word starts
    lengths: np.ndarray  # bytes of each word
    first: np.ndarray  # index of the first word of each document, one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        view = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        left = self.lengths
        h = mix(left.astype(U64) * U64(0x2545F4914F6CDD1D))
        h ^= view[self.starts] & _MASK[np.minimum(left, 8)]
        h = mix(h)
        open_, step = np.flatnonzero(left > 8), 8
        while len(open_):
            part = view[self.starts[open_] + step] & _MASK[np.minimum(left[open_] - step, 8)]
            h[open_] = mix(h[open_] * U64(0x9FB21C651E98DF25) ^ part)
            step += 8
            open_ = open_[left[open_] > step]
        return h


def text_buffer(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of string values (null: empty) with eight zero bytes behind, and their n + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if texts.buffers()[2] is not None and len(data) > 8:
        data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if lower:
        data = _LOWER[data]
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Split a buffer of text_buffer() into words; no word crosses a document's end."""
    inside = _SPACE[data[:-8]]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(inside))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    first_byte = np.flatnonzero(starts)
    lengths = np.flatnonzero(ends) + 1 - first_byte
    return Words(data, first_byte, lengths, np.searchsorted(first_byte, offsets))


def slices(table: pa.RecordBatch | pa.Table, column: str = "text", size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most `rows` rows whose texts hold about `size` bytes; a row is never cut."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = (np.cumsum(lengths) - lengths) // size
        cuts = np.union1d(np.flatnonzero(np.diff(at)) + 1, np.arange(rows, batch.num_rows, rows))
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(i, j - i)


def powers(n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the rolling hash's base, modulo 2**64."""
    out = np.full(max(n, 1), _BASE, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """For each position p a hash of h[p : p + size], by prefix sums; windows over the end are left out."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    inverse = pow(_BASE, -1, 1 << 64)
    down = np.full(len(h), inverse, U64)
    down[0] = 1
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * np.cumprod(down, dtype=U64), dtype=U64, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers(len(h))[size - 1 :] ^ U64(size))


def valid_windows(first: np.ndarray, size: int) -> np.ndarray:
    """For each word, whether a window of `size` words that starts there ends in the same document."""
    n = int(first[-1])
    ok = np.ones(n, bool)
    if size > 1 and n:
        over = np.zeros(n + 1, np.int64)
        np.add.at(over, np.maximum(first[1:] - (size - 1), first[:-1]), 1)
        np.add.at(over, first[1:], -1)
        ok = np.cumsum(over[:-1]) == 0
    return ok


def sliding(fn: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """fn (minimum or maximum) over x[p : p + size] for each p, by doubling; shorter at the end."""
    span, out = 1, x
    while span * 2 <= size:
        out = fn(out[: len(out) - span], out[span:])
        span *= 2
    if span < size:
        out = fn(out[: len(out) - (size - span)], out[size - span :])
    return out


def doc_hashes(h: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each document's whole word sequence."""
    n = np.diff(first)
    place = np.arange(len(h), dtype=U64) - np.repeat(first[:-1], n).astype(U64)
    x = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h ^ mix(place * U64(0x632BE59BD9B4E019) + U64(seed))), dtype=U64, out=x[1:])
    return mix((x[first[1:]] - x[first[:-1]]) ^ mix(n.astype(U64) + U64(seed)))
