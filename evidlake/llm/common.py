"""Helpers that the corpus operators share: tables, staging, and vectorised tokenising of Arrow text.

Words are maximal runs of bytes other than space and 0x09-0x0D. A text is tokenised as UTF-8 bytes, so no step depends on
Python strings; a null text has no words. Texts are handled whole: a chunk holds as many whole texts as fit in
``CHUNK_BYTES``, and a longer text is a chunk of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, as in tests, one of this machine, which only a local master allows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-evidlake-"))
        named = _OWN[0]
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: the lineage ends there, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def word_count(text: Column) -> Column:
    """Number of words of a text column, in the JVM; null counts 0."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


# --- vectorised tokenising -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` gets the hash of any span of the bytes."""
    up, _ = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words(NamedTuple):
    row: np.ndarray  # of the chunk, ascending
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    data: np.ndarray  # bytes of the chunk, lower case where asked for
    offsets: np.ndarray  # of the rows in data


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, lower: bool = True) -> Words:
    if lower:
        data = _LOWER[data]
    blank = space[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    first, last = cut[:-1].copy(), cut[1:].copy()
    first[1:] |= blank[:-1]
    last[:-1] |= blank[1:]
    inside = ~blank
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, end, data, offsets)


def word_hashes(w: Words) -> np.ndarray:
    return span_hashes(prefix_hashes(w.data), w.start, w.end)


_MULTIPLIERS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; runs across texts are the caller's to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _MULTIPLIERS[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles as sorted hashes; with fewer words, the whole sequence as one; else empty."""
    w = words(data, offsets)
    hashes = word_hashes(w)
    runs = shingle_hashes(hashes, size)
    bounds = np.searchsorted(w.row, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield shingle_hashes(hashes[a:b], b - a)
        else:
            yield runs[:0]
