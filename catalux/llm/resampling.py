"""Importance resampling towards a target: hashed n-grams, external sort-count, gains, and a weighted draw without return.

Features of a text are all runs of 1 to ``LONGEST`` consecutive words, each put in one of ``BUCKETS`` buckets by its CRC-32.

1. ``streams`` writes, per document, its buckets as packed little-endian uint16 to a table in the shared folder. An Arrow batch
   of that table is one contiguous stream with document offsets, so texts are read and hashed once.
2. ``counted`` sorts the stream of each batch and counts by run lengths; tasks send at most ``BUCKETS`` sums each.
3. ``gains`` turns the counts of target and raw corpus into a whole number per bucket (1000 times the log ratio of the two
   shares with one pseudo-count a bucket, rounded down).
4. ``weighed`` gathers gains along the stream and adds them up by document with ``np.add.reduceat``.
5. ``drawn`` adds Gumbel noise made from the document's id and numbers the rows of the best scores. The order is made by
   range partitions whose sizes are added up, so that no task holds all rows.

What meets in the driver: ``BUCKETS`` counts and one size a partition.

Null or empty text, or text without a word: no features, weight 0, not drawn by default (``least`` words). A null id: its row
has its counts and weight, but no score, and takes no part in the draw. Rows that repeat an id, with equal or other texts, are
documents of their own; equal scores go by id, and of rows that share both the order is that of the counts (equal rows are the
same, whichever is drawn). Very long texts are looked at whole, a block of words at a time. No rows: no rows. Without target
texts gains follow from the raw counts alone. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checksum import CRC_SQL, crc32, crc32_sql, joined
from .common import LOWER, NOT_WORD, materialize, new_path, read, text_steps, utf8, words

BUCKETS = 10_000
LONGEST = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Words whose features are hashed together.
BLOCK = 1 << 15
SPACE_CRC = np.array([0xE96CCF45], np.uint32)  # of one blank


def packed(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the uint16 stream of all its features, and the n + 1 offsets of the texts in the stream."""
    low = LOWER[raw]
    start, end, first = words(low, offsets, NOT_WORD)
    n = np.diff(first)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(sum(np.maximum(n - k, 0) for k in range(LONGEST)), out=at[1:])
    stream, done = np.empty(at[-1], np.uint16), 0
    last = np.repeat(first[1:], n)  # of each word, where its text's words end
    for a in range(0, len(start), BLOCK):
        b = min(len(start), a + BLOCK)
        more = min(len(start), b + LONGEST - 1)
        size = end[a:more] - start[a:more]
        single = crc32(low, start[a:more], end[a:more])
        spaced = joined(np.broadcast_to(SPACE_CRC, single.shape), single, size)
        found, there = np.zeros((b - a, LONGEST), np.uint32), np.zeros((b - a, LONGEST), bool)
        run = single[: b - a]
        for k in range(LONGEST):
            if k:
                m = min(b - a, more - a - k)
                run = joined(run[:m], spaced[k : k + m], size[k : k + m] + 1)
            found[: len(run), k] = run
            there[: len(run), k] = np.arange(a, a + len(run)) + k < last[a : a + len(run)]
        got = (found[there] % np.uint32(buckets)).astype(np.uint16)
        stream[done : done + len(got)] = got
        done += len(got)
    return n, stream, at


def streams(docs: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the packed buckets of every row, as a table in the shared folder."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in uint16")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            n, stream, at = packed(*utf8(b.column("text")), buckets)
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(stream.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), data], ["doc_id", "n_words", "buckets"])

    spark, path = docs.sparkSession, new_path(docs.sparkSession, name)
    has_id = "doc_id" in docs.columns
    src = docs.select((F.col("doc_id") if has_id else F.lit(None)).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, buckets binary"
    src.mapInArrow(write, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = utf8(column)
    return np.frombuffer(raw, "<u2"), offsets // 2


def counted(stream: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: sorted and run-length encoded by batch, added up by task, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            x = np.sort(_stream(b.column("buckets"))[0], kind="stable")
            if len(x):
                runs = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                total[x[runs]] += np.diff(np.append(runs, len(x)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in stream.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, 1000 times the natural log of target share over raw share, rounded down."""
    m, s_all, t_all = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + m) / ((float(s) + 1) * (t_all + m)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(stream: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of the stream table."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _stream(b.column("buckets"))
            n = np.diff(at)
            weight, some = np.zeros(len(n), np.int64), np.flatnonzero(n)
            if len(some):
                weight[some] = np.add.reduceat(gain[x], at[some])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return stream.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """score: weight plus Gumbel noise in thousandths, made from the id, so that it is the same on every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + noise)


def drawn(scores: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """rank: 1, 2, 3... of the ``percent`` of 100 best scores among rows with an id and ``least`` words; else null."""
    spark = scores.sparkSession
    order = [F.col("out"), F.desc("score"), F.col("doc_id"), F.col("n_features"), F.col("weight"), F.col("salt")]
    rows = scores.withColumns({"out": ~F.coalesce((F.col("n_words") >= least) & F.col("score").isNotNull(), F.lit(False)), "salt": F.monotonically_increasing_id()})
    # the number of a row within its partition and that of the partition are the halves of this id
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("salt"), "drawn")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n, r.fit) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum((~F.col("out")).cast("long")).alias("fit")).collect())
    most = sum(x[2] for x in sizes) * percent // 100
    before, base = [], 0
    for p, n, _ in sizes:
        before.append((p, base))
        base += n
    offsets = spark.createDataFrame(before, "part long, base long")
    rank = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part", "left").withColumn("rank", F.when(~F.col("out") & (rank <= most), rank)).drop("at", "part", "base", "out")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row's n_words, n_features, weight, score and rank; ``target`` has the column text."""
    raw = streams(docs, "raw-stream", buckets)
    gain = gains(counted(raw, buckets), counted(streams(target, "target-stream", buckets), buckets))
    return drawn(scored(materialize(weighed(raw, gain), "weights"), seed), percent, least)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return resampled(docs, target.select("text")).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


OP13_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
rows AS (
  SELECT row_number() OVER () AS r, doc_id, text, 0 AS target FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, 1 FROM benchmark),
worded AS (
  SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM rows),
features AS (
  SELECT r, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f
  FROM worded),
hexed AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM features),
hashed AS (SELECT f, {crc32_sql("h")} % {BUCKETS} AS bucket FROM hexed, crc),
placed AS (SELECT r, target, bucket FROM features JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gain AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (s_all + {BUCKETS}) / ((s::DOUBLE + 1) * (t_all + {BUCKETS}))))::BIGINT AS g FROM counts, totals),
weights AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE target = 0 GROUP BY r),
scores AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (r) WHERE target = 0),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS k, count(*) OVER () AS n
  FROM scores WHERE n_words >= {LEAST_WORDS} AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * n // 100 THEN k END AS rank FROM scores LEFT JOIN ranked USING (r)
"""
