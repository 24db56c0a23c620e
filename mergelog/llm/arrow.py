"""Arrow batches as flat numpy arrays: no Python object for each row or word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

# x20 and x09-x0D
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_2
    return x ^ (x >> np.uint64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts_here = word.copy()
    starts_here[1:] &= ~word[:-1] | edge[1:n]
    ends_here = word.copy()
    ends_here[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(starts_here)
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    h = sizes.astype(np.uint64) * ODD
    todo = np.arange(len(starts))
    at = starts
    left = sizes
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while len(todo):
        value = eights[at]
        short = left < 8
        keep = np.where(short, 8 * (8 - left), 0).astype(np.uint64)
        value = value & (full >> keep)
        h[todo] = mix(h[todo] ^ value) * ODD
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return mix(h)


def word_batches(column: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, word starts, word ends, first word of each row, word hashes) for slices of a text column."""
    data, offsets = text_buffers(column)
    for first, last in slices(offsets):
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = LOWER[part]
        at = offsets[first : last + 1] - offsets[first]
        starts, ends, heads = word_bounds(part, at)
        yield first, part, starts, ends, heads, word_hashes(part, starts, ends)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
