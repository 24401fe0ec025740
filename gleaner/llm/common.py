"""Shared helpers: text buffers as numpy arrays, shared scratch tables, null-safe hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.scratch import Scratch  # noqa: F401 - the operators' name for it

#: Rows of one Arrow batch.  Text rows are a few KB on average, so this bounds a worker's memory.
ARROW_ROWS = 1024
#: Bytes of text that a numpy kernel looks at together (one longer text is still taken whole).
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small; a smaller setting of the session is left alone.

    The setting stays, since plans read it when they run.  Batches of long texts are bounded by Spark's own limit of bytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 0) not in range(1, ARROW_ROWS + 1):
        spark.conf.set(key, str(ARROW_ROWS))


def tidy(kernel: Callable) -> Callable:
    """A batch kernel that gives freed memory back at the end of its task: workers live on and are used again."""

    @functools.wraps(kernel)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


#: Keys that a counted join may treat as hot: no more than this many can hold a share above 1 / HOT_KEYS.
HOT_KEYS = 4000


def join_counted(rows: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """rows joined to ``counted`` (key, n, ...; a kept table, one row a key, n: about how many rows have it).

    Keys with more than 1 / HOT_KEYS of all rows are joined by broadcast, so none of them meets in one
    task; there are at most HOT_KEYS of them.  All others are joined by shuffle.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    cut = max(1000, total // HOT_KEYS)
    hot = counted.where(F.col("n") > cut)
    if not hot.limit(1).count():
        return rows.join(counted, key)
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(counted.where(F.col("n") <= cut), key)
    return rows.join(F.broadcast(hot), key).unionByName(usual)


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[U64(1)], np.cumprod(np.full(max(n, 2 * len(_POWERS)), _MULT, U64))])
    return _POWERS


_POWERS = np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs give unrelated outputs."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def split_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the words [^\\x20\\x09-\\x0D]+ in ``raw`` and, per text, its first word's number (n + 1)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    lengths = ends - starts
    powers = _powers(int(lengths.max()) + 1)
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = raw[np.repeat(starts, lengths) + at].astype(U64)
    values += U64(1)
    values *= powers[at]
    return mix(np.add.reduceat(values, first) + lengths.astype(U64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each place; there are len(words) - k + 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    powers = _powers(k + 1)
    out = words[:n].copy()
    for j in range(1, k):
        out += words[j : j + n] * powers[j]
    return mix(out)
