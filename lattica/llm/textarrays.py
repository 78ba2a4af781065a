"""Texts of an Arrow column as NumPy arrays: words, hashes and shingles without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled whole.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32  # words are compared with A-Z lower-cased
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``size`` bytes, or of one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and for each row the place of its first word (one more at the end).

    ``between`` says which bytes separate words.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashed(data, start, end - start), np.searchsorted(start, offsets)


def _hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each word's runs of eight bytes, finalised with their place, are summed: no algebra of the bytes carries over to the sum."""
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data]
    eight = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    runs = (length + 7) >> 3
    first = np.cumsum(runs) - runs
    place = np.arange(int(runs.sum())) - np.repeat(first, runs)
    left = np.minimum(np.repeat(length, runs) - 8 * place, 8)
    value = eight[np.repeat(start, runs) + 8 * place] & _MASK[left]
    value = mix(value ^ place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if len(value) > len(runs):
        value = np.add.reduceat(value, first)
    return mix(value + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row, and each row's first; a shorter row's words are one run."""
    counts = np.diff(first)
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(per_row)])
    total = int(out_first[-1])
    row = np.repeat(np.arange(len(counts)), per_row)
    at = first[row] + np.arange(total) - out_first[row]
    length = np.minimum(counts[row], size)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = np.zeros(total, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(k < length, padded[at + k], np.uint64(0))
    return mix(out + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), out_first
