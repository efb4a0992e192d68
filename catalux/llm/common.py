"""Shared helpers of the training-data operators: shared folder, tables, text batches.

Conventions that hold for every operator of this subpackage:

* A null ``doc_id`` row is kept in the result with its own counts, is never
  linked with, removed by or used as a source for another row.
* A null text is an empty text.
* Rows that repeat a ``doc_id`` are treated as separate documents of equal id.
* Only the columns an operator names are read; further columns, whatever their
  names, are ignored (pipeline stages carry the columns of ``documents`` only).
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text that one Python step holds at a time (a longer text is a step of its own).
STEP_BYTES = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="catalux-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # a static setting in some versions
            spark.sparkContext._conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/catalux/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a place in the shared folder, for executors."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.compression.codec.zstd.level", 1).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM find shuffles that no frame refers to, so that their files go."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of an Arrow batch: with texts of some kB, a few MB in the JVM and in Python.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, with Arrow batches of the session bounded for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes."""
    for b in batches:
        if b.num_rows == 0:
            continue
        each = max(1, int(limit // max(1, b.nbytes / b.num_rows)))
        for i in range(0, b.num_rows, each):
            yield b.slice(i, each)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, concatenated, and the n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


#: Odd multipliers of the polynomial hashes; any odd values do.
BASE = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


def window_hash(s: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of each of the ``len(s) - k + 1`` windows of ``k`` symbols, by doubling."""
    n = len(s) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, size, out, done, at = s, 1, None, 0, k
    while True:
        if at & 1:
            if out is None:
                out = part.copy() if part is s else part
            else:  # the larger block goes in front of what there is
                m = len(s) - (done + size) + 1
                out = part[:m] * np.uint64(pow(base, done, 1 << 64)) + out[size : size + m]
            done += size
        at >>= 1
        if not at:
            return mix(out[:n].copy() if out is s else out[:n])
        m = len(part) - size
        part = part[:m] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, by doubling."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n]) if size < w else x[:n]


#: Bytes of the two kinds of word in the contracts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = False
NOT_WORD[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are not ``gap`` within each document.

    Returns the start and end of each word and, per document, the number of its first word (n + 1 of them).
    """
    inside = ~gap[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = inside
    now = np.append(inside, False)
    starts = np.flatnonzero(now & (~before | cut))
    ends = np.flatnonzero(before & (~now | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hash of each ``s[start:end]``, from polynomial prefix sums modulo 2**64."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(s)
    powers = np.full(n + 1, np.uint64(base))
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)))
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
    h = (total[end] - total[start]) * back[start]
    h += (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return mix(h)


def word_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    return span_hash(raw, starts, ends, base)
