"""Shared pieces: words and hashes of whole texts, shared tables, blocks.

Words are maximal runs of bytes outside space and 0x09-0x0D.  All separators
are ASCII, so working on UTF-8 bytes finds the same words as code points do.
Hashes are 64-bit Rabin-Karp polynomials (odd base, modulus 2**64) closed by
an avalanche mix; prefix sums give the hash of every span at once.
"""

from __future__ import annotations

import ctypes
import math
import os
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# functions travel to the Python workers by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once in a task (a longer document is handled alone).
SLICE_BYTES = 1 << 20
#: Blocks of the given size that ask each other, before blocks grow; and partitions that hold them.
SPREAD, MOST_PARTITIONS = 512, 16_384

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        base = np.full(size, _BASE, U64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
        base[1:] = U64(_BASE_INV)
        _inverses = np.multiply.accumulate(base)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, so that any bits of the result are usable."""
    h = np.asarray(h, U64)
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span, independent of position."""
    n = len(values)
    power, inverse = _tables(n + 1)
    # one array of eight bytes a value: a task's memory is mostly this
    sums = np.zeros(n + 1, U64)
    term = sums[1:]
    term[:] = values
    term += U64(1)
    term *= power[:n]
    np.cumsum(term, out=term)
    poly = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(poly + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each row's bounds; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo, hi = (int(bounds[0]), int(bounds[-1])) if len(bounds) else (0, 0)
    return data[lo:hi], bounds - lo


def pieces(batch, column: str = "text", most: int = SLICE_BYTES):
    """Row slices of a batch with at most ``most`` text bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total, begin = np.cumsum(size), 0
    while begin < n:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker lives on, idle or with
    another stage's tasks, and an executor's limit counts what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's, where it is used
    if trim:
        trim(0)


class Words:
    """Words of a run of documents: spans, hashes, and where each document's begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SEPARATOR):
        self.data, self.bounds = data, bounds
        inside = ~separator[data]
        start, end = inside.copy(), inside.copy()
        if len(data):
            begins = bounds[:-1][bounds[:-1] < bounds[1:]]
            start[1:] &= ~inside[:-1]
            start[begins] = inside[begins]
            end[:-1] &= ~inside[1:]
            lasts = bounds[1:][bounds[:-1] < bounds[1:]] - 1
            end[lasts] = inside[lasts]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.inside = inside

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """Word hashes; ``table`` maps bytes first (lower case, say)."""
        return span_hashes(self.data if table is None else table[self.data], self.starts, self.ends)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """Starting words of all windows of ``size`` words within one document."""
        n = len(self.starts)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        return np.flatnonzero(left >= size)


def ragged(array_offsets: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(array_offsets.astype(np.int32)), pa.array(values, kind))


# --------------------------------------------------------------------------- Spark side

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Only a local
    session may leave it unset; it then gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textbench-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage with
    files that outlive any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_prefix(columns) -> str:
    """A beginning of names that no column's name has, whatever the case: helper
    columns with it replace none of the caller's."""
    prefix = "h_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def text_size(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one pass with a partial sum."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def block_count(total_bytes: int, block_bytes: int) -> int:
    return max(1, -(-total_bytes // block_bytes))


def asking_blocks(total_bytes: int, block_bytes: int) -> int:
    """Blocks that ask each other: each sends a row to every hash range, of which
    there are as many.  Up to ``SPREAD`` blocks have ``block_bytes``; beyond, blocks
    grow with the square root of the input, and the rows sent in proportion to it."""
    n = block_count(total_bytes, block_bytes)
    return min(n, math.isqrt(SPREAD * n))


def dealt_by(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows of a block in one partition; a partition handles one block after the other."""
    return df.repartition(min(blocks, MOST_PARTITIONS), key)


def block_of(blocks: int, *keys: str | Column) -> Column:
    """Block of a row by its keys: the same on every run, whatever the partitions."""
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
