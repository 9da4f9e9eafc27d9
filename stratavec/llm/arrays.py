"""Arrow and numpy helpers of the operators that work on batches of texts."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def eights(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place of data on, zeros beyond its end; a view that shares one copy of the bytes."""
    return np.ndarray((len(data) + 1,), kind, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


#: Masks that keep the first 0 to 8 bytes of a little-endian value.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def eight_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """64-bit hashes of slices, each mixed in whole after every eight bytes; no power of a base, so no pattern of letters cancels."""
    source, out = eights(data), mix64(size.astype(U64) + U64(seed))
    live, at, left = np.arange(len(start)), start, size
    while len(live):
        value = source[at] & KEEP[np.minimum(left, 8)]
        out[live] = mix64((out[live] ^ value) * U64(0x9E3779B97F4A7C15) + U64(0xD1B54A32D192ED03))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on are mapped by themselves, and go back when they are freed
        return libc
    except (OSError, AttributeError):  # another C library
        return None


def freeing(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, whose worker gives the memory that it has freed back to the machine at the end: idle workers hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if libc:
            libc.malloc_trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the len + 1 offsets into them."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(b: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of b in parts whose texts have at most limit bytes, or one row."""
    _, offsets = utf8(b.column(column))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield b.slice(i, min(j, b.num_rows) - i)
        i = j


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length in one value; unpack() needs their types."""
    return b"".join([len(columns[0]).to_bytes(8, "little"), *[np.ascontiguousarray(c).tobytes() for c in columns]])


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def split_by(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket, in their order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    columns = [c[order] for c in columns]
    return [(int(b[i]), [c[i:j] for c in columns]) for i, j in zip(cuts, [*cuts[1:], len(b)], strict=True)]


def batch(schema: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))
