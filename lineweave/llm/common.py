"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Parts of a key whose first rows are ranked apart.
PARTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; set to a local one only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-lineweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table written to the shared folder: lineage ends there and no executor holds the only copy."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _summed(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in batch.column("cells"))
    return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)])})


def sum_vectors(parts: DataFrame, width: int) -> np.ndarray:
    """The sums of packed vectors of fixed length, by their number k, laid end to end; `width` in all.

    Sums of a part of the partitions come first, so that no task gets a vector of each.
    """
    near = parts.withColumn("to", F.pmod(F.spark_partition_id(), F.lit(32)))
    half = near.groupBy("k", "to").applyInArrow(_summed, "k int, cells binary")
    rows = {r.k: np.frombuffer(zlib.decompress(r.cells), "<i8") for r in half.groupBy("k").applyInArrow(_summed, "k int, cells binary").toLocalIterator()}
    if not rows:
        return np.zeros(width, np.int64)
    step = len(next(iter(rows.values())))
    return np.concatenate([rows.get(k, np.zeros(step, np.int64)) for k in range(-(-width // step))])[:width]


def smallest(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The `most` rows of each key that come first in order.

    Each of PARTS parts of a key sends on its own first ones, so that a task ranks at most PARTS x most rows of a hot key.
    """
    columns, part = rows.columns, F.pmod(F.xxhash64(*order), F.lit(PARTS))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("_part", part).withColumn("_rank", rank(key, "_part")).where(F.col("_rank") <= most)
    return first.withColumn("_rank", rank(key)).where(F.col("_rank") <= most).select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python of at most so many rows and bytes, so that tasks need little memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator works on; other columns, whatever their names, don't reach Python."""
    small_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len(array) + 1 offsets of a string array; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes add up to `most` or that are one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the maximal runs of word bytes that don't cross a row, and the row of each run."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | first[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _INV)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal runs wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position on; the last k - 1 positions have none. Windows may cross rows: mask them."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _ODD + word_hash[j : j + n]
    return mixed(h)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words between ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
