"""Helpers shared by the text operators: tables on the shared folder, byte arrays, words, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import threading
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relaygauge.session import shared_folder

# Bytes of text that a Python worker holds in its arrays at once (a longer text comes alone).
CHUNK_BYTES = 1 << 20

# Odd 64-bit multipliers of the mixing steps, and the base of word hashes.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
BASE = 0xD6E8FEB86659FD93


class _Work(threading.local):
    """Folders of the tables that the operators now at work in a thread have staged, innermost last."""

    def __init__(self):
        self.folders: list[list[str]] = []


_OPEN = _Work()


def stage(table: DataFrame, purpose: str) -> DataFrame:
    """``table`` written to the folder that all executors share, and read again.

    Cuts the lineage: what follows survives the loss of executors without computing it anew.
    """
    folder = shared_folder(table.sparkSession, purpose)
    if _OPEN.folders:
        _OPEN.folders[-1].append(folder)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def finished(spark: SparkSession, purpose: str, work: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``work``, staged; tables that it staged on the way are removed."""
    folders: list[str] = []
    _OPEN.folders.append(folders)
    try:
        result = work()
    except BaseException:
        _OPEN.folders.pop()
        raise
    _OPEN.folders.pop()
    out = stage(result, purpose)
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def give_back() -> None:
    """Memory that a worker has freed goes back to the system, and not only to its next arrays.

    An executor's memory holds its workers' too, and a worker stays for the stages that follow.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(text: str) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def byte_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary column without nulls, and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    width = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``limit`` bytes at most, or a single row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def byte_class(pattern_bytes: Sequence[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


# The word classes [^\x00-\x2F\x3A-\x60\x7B-\x7F] (after lower-casing A-Z) and
# [^\x20\x09-\x0D], byte by byte; a byte from 0x80 on belongs to a word in both.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
VISIBLE = ~byte_class([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# The same classes as regular expressions of Spark SQL.
ALNUM_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VISIBLE_SPLIT = r"[\x20\x09-\x0D]+"


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in joined texts; no word crosses from one text to the next."""
    inside = member[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    before[edges[edges < len(inside)]] = False
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def mix(values: np.ndarray) -> np.ndarray:
    out = values ^ (values >> np.uint64(29))
    out *= MIX_A
    out ^= out >> np.uint64(32)
    out *= MIX_B
    out ^= out >> np.uint64(29)
    return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < count:
        size = max(count, CHUNK_BYTES + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if size <= CHUNK_BYTES + 4096:
            _POWERS[base] = known
    return known[:count]


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _powers(BASE, len(data)), out=sums[1:])
    back = _powers(pow(BASE, -1, 1 << 64), len(data))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each position of joined texts lies in."""
    return np.searchsorted(offsets, positions, side="right") - 1


def first_of_each(table: DataFrame, group: str, order: Sequence[str], rows: int) -> DataFrame:
    """The first ``rows`` of each ``group`` by ``order``; parts of a group are cut before they meet."""
    salted = table.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    for by in ([group, "_salt"], [group]):
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        salted = salted.withColumn("_rank", rank).where(F.col("_rank") <= rows)
    return salted.select(*table.columns)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus
