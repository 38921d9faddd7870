"""Shared helpers: texts of Arrow batches as byte arrays, hashing, and null-safe row keys."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 2 << 20
U64 = np.uint64


def release() -> None:
    """Give freed memory back: Python workers live on from stage to stage, and their allocators keep what a task has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(fn: Callable) -> Callable:
    """A ``mapInArrow`` function that gives memory back when its task ends."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def lean_group(fn: Callable) -> Callable:
    """An ``applyInPandas`` function of one argument that gives memory back after each group."""

    @functools.wraps(fn)
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = fn(group)
        release()
        return out

    return run


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null: empty) of ``df``; other columns cannot clash after this."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def row_key(df: DataFrame) -> DataFrame:
    """Add ``rk``: rows that share doc_id and rk are the same row written twice, so either may stand for both."""
    return df.withColumn("rk", F.xxhash64("doc_id", "text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on (doc_id, rk); null ids match each other."""
    return (a["rk"] == b["rk"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def packed_texts(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text, rk) with the text compressed into ``packed``, to be shuffled; see ``unpack_text``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                packed = pa.array([pack(t.encode()) for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), packed], ["doc_id", "rk", "packed"])

    return df.select("doc_id", "text", "rk").mapInArrow(run, "doc_id long, rk long, packed binary")


def unpack_text(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def byte_slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows as ``(first row, end row, bytes, offsets)``, about ``budget`` bytes each and one row at least.

    A row is never split. Nulls read as empty.
    """
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; UTF-8 continuation and lead bytes are above that range."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    out[1:] = base & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for many spans at once; equal bytes give equal hashes."""
    n = len(data)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, n), out=prefix[1:])
    back = powers(BASE_INVERSE, n + 1)
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (places whose eight bytes end beyond the data are absent)."""
    x = data.astype(U64)
    for step in (1, 2, 4):
        x = (x[:-step] << U64(8 * step)) | x[step:] if len(x) > step else x[:0]
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; a word ends with its row."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=U64).view(np.int64)


BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast when its counted size is within ``BROADCAST_BYTES``; Spark shuffles it otherwise."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
