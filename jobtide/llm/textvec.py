"""Vectorised text helpers for Arrow batches inside tasks: byte slices, words, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are taken in slices of about this many bytes, so that temporaries stay small; a longer text is its own slice.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_text(docs: DataFrame, text: str, keep: tuple[str, ...], *more: str) -> DataFrame:
    """The columns to keep, then the text as ``text`` unless it is kept anyway, then ``more``."""
    own = [] if "text" in keep and text == "text" else [docs[text].alias("text")]
    return docs.select(*keep, *own, *more)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on from job to job, and what it keeps counts for its executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, of about ``most`` bytes and ``rows`` rows at most, with the bytes and offsets of their texts."""
    for batch in batches:
        give_back()
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            stop = min(stop, row + rows, batch.num_rows)
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop


def of_text(text: Column, kind: str, run: Callable[[np.ndarray, np.ndarray], list[pa.Array]], most: int, rows: int = 1 << 30) -> Column:
    """A struct of type ``kind`` for each text; ``run`` makes its fields from the bytes and offsets of a slice of texts.

    Only texts enter the Python worker and only results leave it; further columns of the rows stay in the JVM.
    """
    names = [f.strip().split(" ")[0] for f in kind.split(",")]

    def each(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [pa.StructArray.from_arrays(run(data, offsets), names) for _, data, offsets in slices(iter([batch]), most=most, rows=rows)]
            if parts:
                yield pa.concat_arrays(parts)

    # Not deterministic to the optimiser: a filter on the result is not to run the function a second time.
    return F.arrow_udf(each, kind, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(text)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for factor in (_STEP, pow(_STEP, -1, 1 << 64)):
        steps = np.full(n, factor & _MASK, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ``gaps`` (ASCII blanks), and the number of words before each row (rows + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], first[1:] = True, gap[:-1]
    last[-1], last[:-1] = True, gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    last[inner - 1] = True
    starts, ends = np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes, from one pass of a rolling polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, (len(data) - 1).bit_length())  # one size for all slices but very long texts
    up, down = _powers(size)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_letters()[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)


def lists(values: pa.Array | np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
