"""What several operators share: Arrow text buffers, words and their hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from noticelake.storage import ship


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, and keeps Arrow batches of long texts small, unless the session says how many rows they have.

    A batch stands in the JVM and in the worker at once, for every core; 10,000 rows, as by default, are 30 MB of documents. Operators work in slices of at most 512 rows anyhow.
    """
    ship(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "256")


def slices(column: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about so many bytes: they bound what a batch needs, whatever its size."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        full = int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, "right"))
        stop = max(at + 1, min(full, at + most_rows, len(column)))
        yield at, stop
        at = stop


def in_slices(column: pa.Array, body, most_bytes: int = 1 << 20) -> pa.Array:
    """``body`` over one stretch after the other, put together again."""
    out = []
    for a, b in slices(column, most_bytes):
        out.append(body(column.slice(a, b - a)))
        release()
    return pa.concat_arrays(out) if out else body(column)


def release() -> None:
    """Gives memory that a batch has freed back to the system: workers of many stages share it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: The white space that separates words: space and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every row the index of its first word.

    A word is a maximal run of bytes for which ``blank`` is false, within one row.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~blank[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    # rows touch each other in the buffer: a row's first byte always starts a word, its last always ends one
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first] = inside[first + 1]
    ends[last] = inside[last + 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a 64-bit value over all of its bits."""
    h = np.array(h, np.uint64)  # a copy, which is mixed in place
    if not h.ndim:
        return mix(h[None])[0]
    high = h >> np.uint64(30)
    h ^= high
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(27), out=high)
    h ^= high
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=high)
    h ^= high
    return h


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    inner = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
    at = inner + np.repeat(starts, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    return mix(np.add.reduceat(_BYTE[data[at]] * power[inner], begin) + length.astype(np.uint64))


def rolling(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Rabin-Karp hash at every position over the words at the given offsets from it.

    The result is shorter than ``h`` by the largest offset.
    """
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for o in offsets:
        out = out * _BASE + h[o : o + n]
    return mix(out)
