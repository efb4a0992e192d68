"""Quality rules: fixed base rules, and a hashed n-gram log-likelihood ratio.

``fit`` counts hashed uni- and bigrams of tokens (runs of letters and digits, runs of other characters) in
two multinomials: the raw corpus, over all documents, and the trusted target, over the labelled documents of good
quality that are not toxic. The ratio of a bucket is log target share - log raw share, with ``PRIOR`` pseudo-counts spread
like the raw corpus. A document's score is the mean ratio of its n-grams (length-normalised). The threshold is
the score that all but ``LOSS`` of held-out target documents reach (every second one; the rest make the target
counts), so it is fixed by data and parameters.

Every labelled document takes part, as target or in the threshold; raw counts are over every document. Labelled ids are
numbered by range partitions and sent to the documents in blocks of ``IDS``, each with a pass over the documents: ids travel, texts
are never shuffled. The threshold is found by counts of ever narrower ranges of scores. What meets in the driver is
``BUCKETS`` numbers, ``FEW`` scores or the ``IDS`` ids of a broadcast at a time.

Null or empty text: no words, so the base rules fail. Documents without any n-gram have score 0. Null labels
are no labels; an id labelled twice counts as target if one label says so. Null and repeated ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, LOWER, SPACE, materialize, read, span_hash, text_steps, utf8, window_hash, word_hash, words

BUCKETS = 1 << 14
PRIOR = 1000.0
LOSS = 0.005
#: Scores that are ordered in the driver at most, where ranges have narrowed to them.
FEW = 10_000
#: Labelled ids that are broadcast at a time, some 32 MB.
IDS = 1_000_000
MIN_WORDS = 50
REPEAT_PERCENT = 50

#: Token classes of bytes: 0 white space and control, 1 letters, digits and non-ASCII, 2 the rest.
CLASS = np.full(256, 2, np.uint8)
CLASS[:0x21] = 0
CLASS[0x30:0x3A] = CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = CLASS[0x80:] = 1
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
POINT = np.ones(256, bool)  # the first byte of a code point that is no white space
POINT[0x80:0xC0] = False
POINT[SPACE] = False


def ngrams(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the uni- and bigrams of each document, and the document of each."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none
    kind = CLASS[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    at = offsets[:-1]
    new[at[at < len(raw)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(raw))
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    if not len(start):
        return none, none
    h = span_hash(LOWER[raw], start, end)
    doc = np.searchsorted(offsets, start, side="right") - 1
    two = window_hash(h, 2)
    same = doc[1:] == doc[:-1]
    return (np.concatenate([h, two[same]]) % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[1:][same]])


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, doc = ngrams(raw, offsets, len(self.ratio))
        n = len(offsets) - 1
        total, count = np.bincount(doc, self.ratio[bucket], n), np.bincount(doc, minlength=n)
        return total / np.maximum(count, 1)


def sides(labels: DataFrame) -> DataFrame:
    """(doc_id, held): the ids of good quality, every second one in order of id held out; a single one is on both sides."""
    return numbered(labels)[0].drop("number")


def numbered(labels: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, number, held) of ``sides``, numbered from 0 in order of id, and how many numbers there are."""
    spark = labels.sparkSession
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # stored first, as ranges are found by a sample; the number of a row in its partition and that of the partition are the halves of this id
    placed = materialize(materialize(good, "good-ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("at", F.monotonically_increasing_id()), "good-places")
    part = F.shiftright("at", 33)
    before, base = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        before.append((r.part, base))
        base += r["count"]
    offsets = spark.createDataFrame(before, "part long, base long")  # a row for each partition
    number = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("doc_id", number.alias("number"), (number % 2 == 1).alias("held"))
    return (out.unionByName(out.withColumn("held", F.lit(True))) if base == 1 else out), base


def labelled(src: DataFrame, side: DataFrame, n: int, held: bool, ids: int | None = None) -> Iterator[DataFrame]:
    """The texts of one side in parts: the rows of ``src`` whose id is in a block of the ids, of which there are ``n``."""
    ids = ids or IDS
    for i in range(0, n, ids):
        block = side.where((F.col("number") >= i) & (F.col("number") < i + ids) & (F.col("held") == held))
        yield src.join(F.broadcast(block.select("doc_id")), "doc_id").select("text")


def nth(scores: DataFrame, k: int, few: int = FEW) -> float:
    """The k-th smallest score, from 0: of the parts of a range the one it is in is taken until ``few`` are left, or equal ones."""
    inside = scores
    while True:
        low, high, n = inside.agg(F.min("score"), F.max("score"), F.count("*")).first()
        if low == high:
            return low
        if n <= few:
            return sorted(r.score for r in inside.collect())[k]
        at = F.least(F.floor((F.col("score") - low) / (high - low) * 1024), F.lit(1023))
        for r in sorted(inside.groupBy(at.alias("at")).count().collect()):
            if k < r["count"]:
                break
            k -= r["count"]
        inside = inside.where(at == r.at)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, loss: float = LOSS) -> Model:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    side, n_ids = numbered(labels)
    side = materialize(side, "good-sides")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for b in text_steps(batches):
            found += np.bincount(ngrams(*utf8(b.column("text")), buckets)[0], minlength=buckets)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["bucket", "n"])

    def counted(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r.bucket] = r.n
        return out

    raws, targets = counted(src), sum((counted(x) for x in labelled(src, side, n_ids, False)), np.zeros(buckets))
    share = (raws + 1e-3) / (raws + 1e-3).sum()
    model = Model(np.log((targets + prior * share) / (targets.sum() + prior)) - np.log(share), -np.inf)
    if not targets.sum():
        return model  # nothing is trusted: no document is rejected by the ratio

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.scores(*utf8(b.column("text"))))], ["score"])

    parts = [materialize(x.mapInArrow(score, "score double"), "held-scores") for x in labelled(src, side, n_ids, True)]
    scores = reduce(DataFrame.unionByName, parts)
    if n := scores.count():
        model.threshold = float(nth(scores, int(loss * n)))
    return model


def counts(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    starts, ends, first = words(raw, offsets, SPACE)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    w = word_hash(raw, starts, ends)
    repeat = np.zeros(n, np.int64)
    if len(w) > 2:
        h, at = window_hash(w, 3), np.arange(len(w) - 2)
        doc = np.searchsorted(first, at, side="right") - 1
        ok = at + 3 <= first[doc + 1]
        h, at, doc = h[ok], at[ok], doc[ok]
        o = np.lexsort((h, doc))
        same = (h[o][1:] == h[o][:-1]) & (doc[o][1:] == doc[o][:-1])
        twice = np.zeros(len(o), bool)
        twice[1:] |= same
        twice[:-1] |= same
        inside = np.zeros(len(w), bool)
        for k in range(3):
            inside[at[o][twice] + k] = True
        repeat = np.diff(np.concatenate([[0], np.cumsum(inside)])[first])
    lines = np.zeros(n, np.int64)
    data = raw.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        parts = data[a:b].split(b"\n")
        if len(parts) > len(set(parts)):
            solid = [x for x in parts if x.strip(b" \t\r\x0b\x0c")]
            lines[i] = len(solid) - len(set(solid))
    return [np.diff(first), per(POINT[raw]), per(SYMBOL[raw]), lines, repeat]


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of ``SCORED`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            c, failed, score, kept = _verdict(model, b.column("text"))
            cols = [b.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in c], pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORED.split(", ")])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, SCORED)


def _verdict(model: Model, column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    c = counts(column)
    failed = (c[0] < MIN_WORDS) | (100 * c[4] > REPEAT_PERCENT * c[0])
    score = model.scores(*utf8(column))
    return c, failed, score, ~failed & (score >= model.threshold)


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``documents``, in one pass after fitting."""
    model, docs = fit(docs, labels), docs.select(*DOC_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            yield b.filter(pa.array(_verdict(model, b.column("text"))[3]))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("score")
