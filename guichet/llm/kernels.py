"""Numpy kernels over Arrow text columns.

A record batch is walked in slices of a bounded number of bytes, so the work arrays of a task stay small whatever
the batch holds; one text is never split, so a text longer than the slice is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
#: Words hashed at once: the bytes of a word take 40 and more while they are multiplied.
_PIECE = 1 << 15
_LONG_WORD = 64

#: The odd multipliers of the splitmix64 finaliser, and an odd base for byte strings.
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(_LONG_WORD)], dtype=np.uint64)

#: Words are runs of bytes that are neither blanks nor the controls 9 to 13.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words are runs of digits, a-z (after lower-casing) and whatever is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (absolute) of a text column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive rows holding about `limit` bytes."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(rows, max(stop, row + 1))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    inside = kind[data]
    left, right = inside.copy(), inside.copy()
    if len(data):
        left[1:] &= ~inside[:-1]
        right[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        left[edges] = inside[edges]
        right[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(starts) > _PIECE:
        return np.concatenate([word_hashes(data, starts[i : i + _PIECE], ends[i : i + _PIECE]) for i in range(0, len(starts), _PIECE)])
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    inner = np.arange(total) - np.repeat(first, lengths)
    values = _LOWER[data[np.repeat(starts, lengths) + inner]].astype(np.uint64) + np.uint64(1)
    values *= _POWERS[np.minimum(inner, _LONG_WORD - 1)]
    out = mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP)
    for i in np.flatnonzero(lengths > _LONG_WORD):
        digest = hashlib.blake2b(_LOWER[data[starts[i] : ends[i]]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def chain(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive word hashes (row limits are the caller's matter)."""
    count = max(0, len(hashes) - length + 1)
    out = np.full(count, np.uint64(length), np.uint64)
    for k in range(length):
        out = mix(out * _STEP + hashes[k : k + count])
    return out


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, with the length appended."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count) for every pair."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def bucket_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each key; buckets are ranges of keys."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.int64)


def dealt(keys: np.ndarray, parts: int, *columns: np.ndarray, pack: Callable = np.ndarray.tobytes) -> Iterator[tuple[int, list]]:
    """Deal rows out by key: (bucket, packed columns). Rows of a bucket keep their order, so runs stay compressible."""
    bucket = bucket_of(keys, parts)
    order = np.argsort(bucket, kind="stable")
    edges = runs(bucket[order])
    packed = [c[order] for c in (keys, *columns)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[order[a]]), [pack(c[a:b]) for c in packed]


def gathered(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list) -> list[np.ndarray]:
    """Unpack what `dealt` packed: one array for each column over all rows of a partition."""
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        for k, (name, kind) in enumerate(zip(names, kinds)):
            data, offsets = buffers(batch.column(batch.schema.names.index(name)))
            parts[k].append(data[offsets[0] : offsets[-1]].view(kind).copy() if len(offsets) > 1 else np.zeros(0, kind))
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds)]
