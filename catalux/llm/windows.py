"""Super-windows: the first stages of the suffix-array and the substring operators.

Both ask, for each window of ``length`` consecutive symbols (bytes or words),
whether the same window also starts in a document with a smaller ``doc_id``.
Each window has a *minimizer*, the least hash of the ``k``-symbol strings in it.
It is a function of the window's content, so equal windows have equal
minimizers, and a window whose minimizer occurs in one document only can't
repeat elsewhere. A *run* is a maximal series of consecutive windows of one
document with the same minimizer.

0. Of equal texts only the one of the least document is looked at.
1. Minimizers go to buckets in compressed blocks; a bucket finds those of two
   texts or more, and each text gets the list of its own.
2. ``with_shared``: the texts, compressed, meet these lists by document.

Everything here is candidate search without loss: verdicts come later, from
the windows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, release, text_steps, utf8, window_hash, window_min, word_hash, words


#: A minimizer in more runs than this is hot: its windows go to shards one by one. So many runs are some MB of a shard.
HOT = 1 << 17
#: A step with this many texts of a minimizer takes it for hot, see ``_keys``. Steps are of one size, so inputs of any size
#: have the same share of hot minimizers.
LOCAL = 256
STEP_RUNS = 1 << 18
#: Bytes of text for each bucket of minimizers: about four million runs, looked at in parts.
BUCKET_BYTES = {"byte": 64 << 20, "word": 256 << 20}
PARTS = 8
#: Minimizers keep 48 bits; that two differ and agree in these costs work, not correctness.
MASK = np.uint64((1 << 48) - 1)


def symbols(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Symbols of a text column as 64-bit values, the n + 1 offsets of its documents, and (raw, starts, ends)."""
    raw, offsets = utf8(column)
    if kind == "byte":
        return raw.astype(np.uint64), offsets, (raw, None, None)
    starts, ends, first = words(raw, offsets, SPACE)
    return word_hash(raw, starts, ends), first, (raw, starts, ends)


def runs(s: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Document index, first window, number of windows and minimizer of each run of windows within documents."""
    n = len(s) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    least = window_min(window_hash(s, k), length - k + 1)
    ok = np.zeros(len(s) + 1, np.int32)  # windows that don't cross a document's end
    size = np.diff(offsets)
    long = size >= length
    np.add.at(ok, offsets[:-1][long], 1)
    np.add.at(ok, offsets[1:][long] - length + 1, -1)
    ok = np.cumsum(ok[:n]).astype(bool)
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    at = offsets[:-1][long]
    new[at[at < n]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    keep = ok[start]
    start, count = start[keep], count[keep]
    return np.searchsorted(offsets, start, side="right") - 1, start, count, least[start]


def _keys(kind: str, length: int, k: int, buckets: int, local_rows: int):
    """Rows (bucket, block): a step's runs as zstd blocks of 48-bit minimizers, in order, and their documents.

    A minimizer in ``local_rows`` rows of one step or more is taken for hot, and known to be shared. Its list stays out of
    its bucket, which gets one summary, and goes to a bucket of the step's own (below 0). So no bucket holds more than
    ``local_rows`` entries of one minimizer from a step, however many documents have it.
    """


    def block(h: np.ndarray, doc: np.ndarray, ids: np.ndarray, hot: np.ndarray) -> bytes:
        gap = np.diff(h, prepend=np.uint64(0))
        planes = np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8).T[:6])
        part = [np.array([len(h), len(ids)], np.int64), ids, doc.astype(np.int32), hot.astype(np.uint8), planes]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in part))

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h, doc, ids = np.concatenate([x[0] for x in held]), [], []
        n = 0
        for x in held:
            doc.append(x[1] + n)
            ids.append(x[2])
            n += len(x[2])
        doc, ids = np.concatenate(doc), np.concatenate(ids)
        o = np.lexsort((doc, h))
        h, doc = h[o], doc[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        differ = np.minimum.reduceat(ids[doc], first) != np.maximum.reduceat(ids[doc], first)
        local = (size >= local_rows) & differ
        is_local = np.repeat(local, size)
        keep = ~is_local
        keep[first] = True
        out = [(-1 - int(h[0]) % buckets, block(h[is_local], doc[is_local], ids, np.ones(int(is_local.sum()))))] if is_local.any() else []
        h, doc, hot = h[keep], doc[keep], is_local[keep]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        for part in np.split(o := np.argsort(bucket, kind="stable"), np.flatnonzero(np.diff(bucket[o])) + 1):
            used, of = np.unique(doc[part], return_inverse=True)
            out.append((int(bucket[part[0]]), block(h[part], of, ids[used], hot[part])))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in text_steps(batches):
            s, offsets, _ = symbols(b.column("text"), kind)
            doc, _, _, h = runs(s, offsets, length, k)
            if len(doc):
                held.append((h & MASK, doc, np.asarray(b.column("k1"))))
            size += len(h)
            if size > STEP_RUNS:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _shared(table: pa.Table, hot_runs: int) -> pa.Table:
    """A bucket's minimizers of two texts or more: (k1, h, hot) of each occurrence. It is sorted in ``PARTS`` parts."""
    z = zstandard.ZstdDecompressor()
    hs, ids, docs, hots, n_ids = [], [], [], [], 0
    for blob in table.column("block").to_pylist():
        raw = z.decompress(blob)
        n, m = map(int, np.frombuffer(raw, np.int64, 2))
        at = 16 + 8 * m
        ids.append(np.frombuffer(raw, np.int64, m, 16).copy())
        docs.append(np.frombuffer(raw, np.int32, n, at) + np.int32(n_ids))
        hots.append(np.frombuffer(raw, np.uint8, n, at + 4 * n) > 0)
        gap = np.zeros((n, 8), np.uint8)
        gap[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, at + 5 * n).reshape(6, n).T
        hs.append(np.cumsum(gap.view(np.uint64).ravel()))
        n_ids += m
    local = table.column("bucket")[0].as_py() < 0
    del table
    h, doc, hot, ids = np.concatenate(hs), np.concatenate(docs), np.concatenate(hots), np.concatenate(ids)
    del hs, docs, hots
    if local:
        return pa.table({"k1": pa.array(ids[doc]), "h": pa.array(h.view(np.int64)), "hot": pa.array(hot)})
    part, out = (h >> np.uint64(40)) % np.uint64(PARTS), []
    for i in range(PARTS):
        mine = np.flatnonzero(part == i)
        mine = mine[np.argsort(h[mine], kind="stable")]
        if not len(mine):
            continue
        x, d, warm_of = h[mine], ids[doc[mine]], hot[mine]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        size = np.diff(np.append(first, len(x)))
        warm = np.logical_or.reduceat(warm_of, first)
        both = warm | (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first))
        warm |= size > hot_runs
        keep = np.repeat(both, size) & ~warm_of  # the summaries' own texts come with their lists
        out.append((d[keep], x[keep], np.repeat(warm, size)[keep]))
    d, x, w = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"k1": pa.array(d), "h": pa.array(x.view(np.int64)), "hot": pa.array(w)})


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2) without nulls: two 64-bit hashes are the identity of a text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return src.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def text_classes(docs: DataFrame, name: str) -> DataFrame:
    """(k1, k2, rep): the least document of each text that several rows have. The others are copies."""
    return materialize(keyed(docs).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), f"{name}-copies")


def with_shared(docs: DataFrame, copies: DataFrame, kind: str, length: int, k: int, name: str) -> tuple[DataFrame, int]:
    """(doc_id, k1, packed, shared, hot): zstd of the text, its shared minimizers, and the hot ones of them.

    Only the least document of each text is there, and only if it shares any minimizer with another text. No list is
    longer than the text has runs. Also the number of all entries. Texts are told apart by k1 here: where two texts
    agree in it, each gets both lists, and only a passage that no third text shares could be missed.
    """
    spark, src = docs.sparkSession, keyed(docs)
    size = src.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // BUCKET_BYTES[kind]) + 6
    local, hot = LOCAL, HOT
    keys = src.select("k1", "text").mapInArrow(_keys(kind, length, k, buckets, local), "bucket long, block binary").groupBy("bucket").applyInArrow(lambda t: _shared(t, hot), "k1 long, h long, hot boolean")
    mine = keys.groupBy("k1").agg(F.collect_set("h").alias("shared"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    shared = materialize(mine, f"{name}-shared")
    del keys, mine
    release(spark)
    n = shared.select(F.sum(F.size("shared").cast("long"))).first()[0] or 0
    # copies meet the lists, not the texts, so that texts are shuffled once
    reps = copies.groupBy("k1").agg(F.collect_list(F.struct("k2", "rep")).alias("reps"))
    first = packed_texts(docs).join(shared.join(reps, "k1", "left"), "k1")
    copy = F.exists("reps", lambda x: (x["k2"] == F.col("k2")) & (x["rep"] != F.col("doc_id")))
    return first.where(~F.coalesce(copy, F.lit(False))).select("doc_id", "k1", "packed", "shared", "hot"), int(n)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, packed): the texts, compressed for a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in text_steps(batches, 4 << 20):
            raw, off = utf8(b.column("text"))
            data = [z.compress(raw[i:j].tobytes()) for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "k1", "k2")), pa.array(data, pa.binary())], ["doc_id", "k1", "k2", "packed"])

    return keyed(docs).mapInArrow(pack, "doc_id long, k1 long, k2 long, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Steps of ``with_shared``'s rows: ids, k1, texts, and offsets and values of the lists ``shared`` and ``hot``."""
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for c in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
            lists = [(np.asarray(x.offsets), np.asarray(x.values).view(np.uint64)) for x in (c.column("shared"), c.column("hot"))]
            yield np.asarray(c.column("doc_id")), np.asarray(c.column("k1")), pa.array([z.decompress(x) for x in c.column("packed").to_pylist()], pa.binary()), *lists


def listed(doc: np.ndarray, h: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which pairs of a document's index and a minimizer are in that document's list."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.uint64)
    tag = np.uint64(0x9E3779B97F4A7C15)
    known = np.sort(values[at[0] : at[-1]] ^ (owner * tag))
    if not len(known):
        return np.zeros(len(h), bool)
    mine = (h & MASK) ^ (doc.astype(np.uint64) * tag)
    return known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; touching ones become one."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    i = np.flatnonzero(new)
    return start[i], end[np.append(i[1:], len(start)) - 1]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    if not len(start):
        return np.zeros(0, np.int64)
    out = np.ones(int(count.sum()), np.int64)
    out[0] = start[0]
    out[np.cumsum(count)[:-1]] = start[1:] - start[:-1] - count[:-1] + 1
    return np.cumsum(out)
