"""Arrow text helpers: whole batches of texts as byte arrays, cut into pieces of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: The six ASCII white-space bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)


def strings(column: pa.Array) -> list[str]:
    """The texts of a column, nulls as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column (null: empty). offsets has one entry more than the column."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds); wraps modulo 2**64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """_ODD**0 .. _ODD**(n-1) modulo 2**64, kept for the largest n so far."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), _ODD, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def inverse_powers(n: int, _kept: list = [np.ones(1, np.uint64)]) -> np.ndarray:
    if len(_kept[0]) < n:
        steps = np.full(max(n, 4096), np.uint64(pow(int(_ODD), -1, 1 << 64)), dtype=np.uint64)
        steps[0] = 1
        _kept[0] = np.multiply.accumulate(steps)
    return _kept[0][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]: a polynomial over the mixed byte values, then a finaliser with the length."""
    n = len(data)
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * powers(n), out=total[1:])
    value = (total[ends] - total[starts]) * inverse_powers(n + 1)[starts]
    return mix(value ^ mix((ends - starts).astype(np.uint64) + np.uint64(seed)))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words (runs of bytes that are not white space) of the texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Rows of an Arrow batch: texts are long, and a batch is held whole on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets no more than BATCH_ROWS rows travel to Python at once in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, in a worker that gives free memory back when the task ends.

    Workers are kept between tasks and several share an executor's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            libc = ctypes.CDLL("libc.so.6")
        except OSError:  # another C library
            libc = None
        pa.set_memory_pool(pa.system_memory_pool())
        yield from function(batches)
        gc.collect()
        if libc is not None:
            libc.malloc_trim(0)

    return run
