"""Vectorised byte-level text helpers shared by the Arrow-batch operators.

Everything works on one flat ``uint8`` buffer with ``int64`` row offsets, as
Arrow stores strings, so a batch of documents costs a handful of numpy calls
and no Python loop over words.  Null texts become empty rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random odd 64-bit value for each byte, the symbol values of rolling hashes.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slabs(batches, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of the batches, each of at most ``limit`` text bytes or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()))
        ends = np.cumsum(np.asarray(lengths.fill_null(0)), dtype=np.int64)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, ends[stop - 1]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of words before each row) of the words ``[^\\x20\\x09-\\x0D]+``; rows bound words."""
    n = len(data)
    inside = ~_SEPARATOR[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offs[(offs > 0) & (offs < n)]
    begin[cuts] = inside[cuts]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all elements of the ranges, in order, and the offset at which each range begins."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    return np.arange(offs[-1]) + np.repeat(starts - offs[:-1], lengths), offs


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes.

    Each block of eight bytes is mixed with its place, and the sum of the mixed
    blocks with the length.  Spans of one length up to eight bytes never clash,
    and no pattern of bytes makes longer ones clash by rule.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    blocks = (lengths + 7) >> 3
    at, offs = ragged(np.zeros(len(starts), np.int64), blocks)
    value = eight[np.repeat(starts, blocks) + (at << 3)]
    last = offs[1:] - 1
    unused = (8 * ((blocks << 3) - lengths)).astype(np.uint64)
    value[last] &= np.uint64(2**64 - 1) >> unused
    value = mix(value ^ mix(at.astype(np.uint64) * BASE + BASE))
    return mix(np.add.reduceat(value, offs[:-1]) + lengths.astype(np.uint64) * BASE)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(data, start, end)


def pack(values: np.ndarray) -> bytes:
    """Sorted or small unsigned numbers as bytes: byte planes, Zstandard. See :func:`unpack`."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(blob: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    dtype = np.dtype(dtype)
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys, stored as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)
