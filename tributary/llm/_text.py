"""Vectorised access to the bytes of Arrow text columns.

Texts are read as the raw UTF-8 buffers Spark hands over, cut into blocks of whole rows of a
bounded size, so that a worker's temporaries don't depend on the batch.  A row longer than the
bound forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
#: Odd multiplier of the hash; a fixed value.
_BASE = 0x9E3779B97F4A7C15
_LONG = 64
_U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings without nulls (null: empty)."""
    array = batch.column(name)
    if array.null_count or not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type)):
        array = array.cast(pa.string()).fill_null("")
    return array


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets count from the first byte."""
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(array: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) for runs of rows of at most ``limit`` bytes."""
    data, at = raw(array)
    row, rows = 0, len(array)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, rows, row + 4096)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of the maximal runs of word bytes; runs end at row borders."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(at) - 1, np.int64)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    first = np.searchsorted(s, at)
    return s, e, np.diff(first)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes under a 64-bit key, the same wherever the span stands.

    Eight bytes at a time are mixed in, so that no sum or polynomial of the bytes decides; spans of
    more than ``_LONG`` bytes take BLAKE2b.
    """
    size = e - s
    out = mix(size.astype(np.uint64) + _U(_BASE))
    if key:
        out = mix(out ^ _U(key))
    if not len(s):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at, left, some = s, size, np.flatnonzero(size <= _LONG)
    while len(some):
        rest = left[some]
        part = words[at[some]] & _MASK[np.minimum(rest, 8)]
        out[some] = mix((out[some] ^ part) * _U(_BASE) + _U(1))
        at, left = at + 8, left - 8
        some = some[rest > 8]
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(blake2b(data[s[k] : e[k]].tobytes(), digest_size=8, key=key.to_bytes(8, "little") if key else b"").digest(), "little")
    return out


def row_of(counts: np.ndarray) -> np.ndarray:
    """Row index of each of the items that ``counts`` deals to the rows."""
    return np.repeat(np.arange(len(counts)), counts)


def table(chars: bytes | range) -> np.ndarray:
    """Lookup table over the 256 bytes: true for those given."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def lists(values: pa.Array | np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list array with ``counts[i]`` consecutive values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
