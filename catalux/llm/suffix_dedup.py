"""Suffix-array dedup: bytes covered by a ``length``-byte string that also starts in a document with a smaller id.

1. Copies of a whole text are removed by its hash; of each text the least document goes on. Super-windows (see
   ``windows``): candidate runs of windows by minimizer, without loss.
2. Runs go to shards by minimizer, in compressed blocks, so that all windows
   of one content meet in one shard. Equal contents of a step are one there, with the step's least document.
3. A shard's contents that have a window hash in common are concatenated and sorted by induced sorting; suffixes
   whose permuted common prefix reaches ``length`` form groups, whose least document is the verdict of their windows. Verdicts
   go back as ranges: whole contents for larger documents, the windows that other contents have earlier for the least one.
   A shard packs them by part of the texts, so that their rows don't grow with the shards that a text's runs go to; a part
   unites the spans of each of its texts.
4. Hot minimizers (``windows.HOT``, ``windows.LOCAL``): each of their windows goes to a shard by its own hash.
5. Spans meet the texts by (doc_id, hash); kept bytes are hashed.

Documents are judged on the input, never on what is left. Null or empty text:
no bytes, nothing removed. Null ``doc_id``: kept whole. Texts of equal id do not
remove each other, and each is judged for itself. Texts shorter than ``length`` are kept whole; very long ones are
looked at whole. No rows: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, release, utf8, window_hash
from .suffix_array import permuted_common_prefix, suffix_array
from .windows import listed, merge_spans, packed_texts, ranges, runs, text_classes, unpacked, with_shared

LENGTH = 50
K = 26
#: Bytes of run contents a shard is meant to hold, and suffixes sorted together.
SHARD_BYTES = 4 << 20
SORT_SUFFIXES = 1 << 19
#: Bytes of text whose equal contents are brought together before the shuffle.
STEP_BYTES = 4 << 20
#: Runs of the texts whose spans are united together.
PART_RUNS = 1 << 19


def _blocks(length: int, k: int, shards: int):
    """Rows (shard, doc_id, k1, block) of a step's distinct contents.

    Of equal contents of a step only the occurrences in its least document go to the shard (0 or more), as a block of many
    contents; those in larger documents are covered already, and go as spans to a shard below 0. So a shard gets a content once a
    step at most, however many documents have it. Windows of hot minimizers are contents of their own, by their own hash.
    """

    def flush(held: list[tuple]) -> Iterator[tuple]:
        h, ids, k1, start, count, at, hot = (np.concatenate(x) for x in list(zip(*held, strict=True))[:7])
        raws = [x[7] for x in held]
        shift = np.cumsum([0, *map(len, raws)])
        at = at + np.repeat(shift[:-1], [len(x[0]) for x in held])
        raw = np.concatenate(raws)
        del raws
        if hot.any():
            w = np.flatnonzero(hot)
            n = count[w]
            size = n + length - 1
            data = raw[ranges(at[w], size)].astype(np.uint64)
            own = window_hash(data, length)[ranges(np.cumsum(size) - size, n)]
            keep = ~hot
            again = lambda x: np.concatenate([x[keep], np.repeat(x[w], n)])
            h, ids, k1 = np.concatenate([h[keep], own]), again(ids), again(k1)
            start, at = (np.concatenate([x[keep], ranges(x[w], n)]) for x in (start, at))
            count = np.concatenate([count[keep], np.ones(len(own), count.dtype)])
        size, whole, number = count + length - 1, raw.tobytes(), {}
        which = np.fromiter((number.setdefault(whole[i:j], len(number)) for i, j in zip(at.tolist(), (at + size).tolist(), strict=True)), np.int64, len(at))
        low = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(low, which, ids)
        least = ids == low[which]
        gone = ~least
        spans = _pack(ids[gone], k1[gone], start[gone], (start + size)[gone])
        for d, x, b in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "k1", "spans")), strict=True):
            yield -1 - x % shards, d, x, b
        one = np.zeros(len(number), np.int64)
        one[which] = np.arange(len(which))  # an occurrence of each content
        contents, key = list(number), h[one]
        del number
        mine = np.flatnonzero(least)
        mine = mine[np.argsort(which[mine], kind="stable")]
        cut = np.searchsorted(which[mine], np.arange(len(contents) + 1))
        shard = (key % np.uint64(shards)).astype(np.int64)
        z = zstandard.ZstdCompressor(level=1)
        for part in np.split(o := np.argsort(shard, kind="stable"), np.flatnonzero(np.diff(shard[o])) + 1):
            where = mine[ranges(cut[part], cut[part + 1] - cut[part])]
            each = (cut[part + 1] - cut[part]).astype(np.int32)
            parts = [np.array([len(part), len(where)], np.int64), key[part], low[part], k1[where], start[where].astype(np.int32), each, size[one[part]].astype(np.int32)]
            yield int(shard[part[0]]), None, None, z.compress(b"".join([*(p.tobytes() for p in parts), *(contents[i] for i in part.tolist())]))

    def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        c = list(zip(*rows, strict=True))
        if c:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], ["shard", "doc_id", "k1", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, k1, texts, shared, hot in unpacked(batches):
            raw, offsets = utf8(texts)
            doc, first, count, h = runs(raw.astype(np.uint64), offsets, length, k)
            ok = listed(doc, h, *shared)
            doc, first, count, h = doc[ok], first[ok], count[ok], h[ok]
            if not len(doc):
                continue
            held.append((h, ids[doc], k1[doc], first - offsets[doc], count, first, listed(doc, h, *hot), raw))
            size += len(raw)
            if size > STEP_BYTES:
                yield from out(flush(held))
                held, size = [], 0
        if held:
            yield from out(flush(held))

    return run


def _pack(doc: np.ndarray, k1: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Rows (doc_id, k1, spans): the union of each text's spans as pairs of int32."""
    if not len(doc):
        return pa.table({"doc_id": pa.array([], pa.int64()), "k1": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
    o = np.lexsort((start, k1, doc))
    doc, k1, start, end = doc[o], k1[o], start[o], end[o]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (k1[1:] != k1[:-1])])
    text = np.cumsum(new) - 1
    s, e = merge_spans(start + (text << 40), end + (text << 40))  # texts do not touch each other
    which = s >> 40
    pair = np.stack([s - (which << 40), e - (which << 40)], 1).astype(np.int32)
    cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    data = [pair[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(pair)), strict=True)]
    return pa.table({"doc_id": pa.array(doc[new]), "k1": pa.array(k1[new]), "spans": pa.array(data, pa.binary())})


def _judge(segments: list[bytes], lows: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, the least document of each of its windows over all segments."""
    x = np.frombuffer(b"".join(segments), np.uint8)
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    y = np.zeros(int((size + 1).sum()), np.uint16)
    y[ranges(begin, size)] = x.astype(np.uint16) + 1
    sa = suffix_array(y, 257)
    common = permuted_common_prefix(y, sa, stop=0)
    group = np.cumsum(common[sa] < length) - 1
    owner = np.repeat(np.arange(len(segments)), size + 1)
    low = lows[owner[sa]].copy()
    short = (begin + size)[owner[sa]] - sa < length
    low[short] = np.iinfo(np.int64).max
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, low)
    verdict = np.empty(len(y), np.int64)
    verdict[sa] = least[group]
    return [verdict[b : b + n - length + 1] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]


def _alike(keys: list[bytes], length: int) -> np.ndarray:
    """Which contents have a window whose hash another content has; the others need no sorting."""
    out = np.zeros(len(keys), bool)
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    hashes = np.empty(int((size - length + 1).sum()), np.uint64)
    at = 0
    for i in range(0, len(keys), 4096):
        n = size[i : i + 4096]
        data = np.frombuffer(b"".join(keys[i : i + 4096]), np.uint8).astype(np.uint64)
        h = window_hash(data, length)[ranges(np.cumsum(n) - n, n - length + 1)]
        hashes[at : at + len(h)] = h
        at += len(h)
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), size - length + 1)
    o = np.argsort(hashes, kind="stable")
    h, owner = hashes[o], owner[o]
    same = (h[1:] == h[:-1]) & (owner[1:] != owner[:-1])
    out[owner[1:][same]] = out[owner[:-1][same]] = True
    return out


def _dealt(ids: np.ndarray, k1: np.ndarray, spans: list[bytes], parts: int) -> pa.Table:
    """Rows (part, block): the spans of a part's texts together."""
    part = (k1.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    o = np.argsort(part, kind="stable")
    size = np.fromiter(map(len, spans), np.int64, len(spans))
    blocks = []
    groups = np.split(o, np.flatnonzero(np.diff(part[o])) + 1) if len(o) else []
    for g in groups:
        blocks.append(b"".join([np.int64(len(g)).tobytes(), ids[g].tobytes(), k1[g].tobytes(), size[g].tobytes(), *(spans[i] for i in g.tolist())]))
    return pa.table({"part": pa.array([int(part[g[0]]) for g in groups], pa.int64()), "block": pa.array(blocks, pa.binary())})


def _united(table: pa.Table) -> pa.Table:
    """Each text's spans, of all blocks of a part."""
    docs, texts, pairs = [], [], []
    for raw in table.column("block").to_pylist():
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, k1, size = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
        docs.append(np.repeat(ids, size // 8)), texts.append(np.repeat(k1, size // 8))
        pairs.append(np.frombuffer(raw, np.int32, offset=8 + 24 * n).reshape(-1, 2).astype(np.int64))
    pair = np.concatenate(pairs)
    return _pack(np.concatenate(docs), np.concatenate(texts), pair[:, 0], pair[:, 1])


def _shard(length: int, parts: int):
    def judge(table: pa.Table) -> pa.Table:
        """A shard's spans by part; those of shards below 0 pass as they are."""
        if table.column("shard")[0].as_py() < 0:
            return _dealt(np.asarray(table.column("doc_id")), np.asarray(table.column("k1")), table.column("block").to_pylist(), parts)
        z = zstandard.ZstdDecompressor()
        number: dict[bytes, int] = {}
        key, which, docs, texts, starts = [], [], [], [], []
        for blob in table.column("block").to_pylist():
            raw = z.decompress(blob)
            n, m = map(int, np.frombuffer(raw, np.int64, 2))
            at = 16
            columns = []
            for kind, c in ((np.uint64, n), (np.int64, n), (np.int64, m), (np.int32, m), (np.int32, n), (np.int32, n)):
                columns.append(np.frombuffer(raw, kind, c, at))
                at += c * np.dtype(kind).itemsize
            h, low, k1, start, each, size = columns
            end = at + np.cumsum(size.astype(np.int64))
            mine = []
            for x, i, j in zip(h.tolist(), (end - size).tolist(), end.tolist(), strict=True):
                c = number.setdefault(raw[i:j], len(number))
                if c == len(key):
                    key.append(x)
                mine.append(c)
            which.append(np.repeat(np.array(mine, np.int64), each))
            docs.append(np.repeat(low, each)), texts.append(k1.copy()), starts.append(start.astype(np.int64))
        del table
        doc, k1, start, which = (np.concatenate(x) for x in (docs, texts, starts, which))
        low = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(low, which, doc)
        contents, key = list(number), np.array(key, np.uint64)
        del number
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        later = low[which] < doc  # covered whole; in the least document of a content, windows that other contents have earlier
        out = [(doc[later], k1[later], start[later], (start + size[which])[later])]
        by = np.argsort(which, kind="stable")
        by = by[~later[by]]
        at = np.searchsorted(which[by], np.arange(len(contents) + 1))

        def settle(batch: list[int]) -> None:
            for i, v in zip(batch, _judge([contents[i] for i in batch], low[batch], length), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (v < low[i]).astype(np.int8), [0]])))
                if len(edge):
                    who, (s, e) = by[at[i] : at[i + 1]], edge.reshape(-1, 2).T
                    n = len(s)
                    at_ = np.repeat(start[who], n)
                    out.append((np.repeat(doc[who], n), np.repeat(k1[who], n), at_ + np.tile(s, len(who)), at_ + np.tile(e, len(who)) + length - 1))

        o = np.argsort(key, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key[o])) + 1, [len(o)]])
        many = np.diff(cut) > 1
        alike = _alike(contents, length)
        batch, held = [], 0
        for i, j in zip(cut[:-1][many].tolist(), cut[1:][many].tolist(), strict=True):
            x = o[i:j][alike[o[i:j]]]
            batch += x.tolist()
            held += int(size[x].sum()) + len(x)
            if held > SORT_SUFFIXES:
                settle(batch)
                batch, held = [], 0
        if batch:
            settle(batch)
        found = _pack(*(np.concatenate(c) for c in zip(*out, strict=True)))
        return _dealt(np.asarray(found.column("doc_id")), np.asarray(found.column("k1")), found.column("spans").to_pylist(), parts)

    return judge


def repeated_spans(docs: DataFrame, copies: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, k1, spans): for each text's least document, its removed bytes as int32 pairs (start, end)."""
    spark = docs.sparkSession
    texts, n = with_shared(docs, copies, "byte", length, k, "suffix")
    shards = max(8, n * (length + 14) // SHARD_BYTES + 1)
    parts = max(32, n // PART_RUNS + 1)
    blocks = texts.mapInArrow(_blocks(length, k, shards), "shard long, doc_id long, k1 long, block binary").groupBy("shard")
    judged = blocks.applyInArrow(_shard(length, parts), "part long, block binary").groupBy("part")
    judged = materialize(judged.applyInArrow(_united, "doc_id long, k1 long, spans binary"), "suffix-spans")
    del texts, blocks
    release(spark)
    return judged


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        removed, n_spans, digest = [], [], []
        for packed, spans in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist(), strict=True):
            text = z.decompress(packed)
            pair = np.minimum(np.frombuffer(spans, np.int32).reshape(-1, 2).astype(np.int64), len(text))
            start, end = merge_spans(pair[:, 0], pair[:, 1])
            sha, at = hashlib.sha256(), 0
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                sha.update(text[at:s])
                at = e
            sha.update(text[at:])
            removed.append(int((end - start).sum())), n_spans.append(len(start)), digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())], ["k1", "k2", "n_removed", "n_spans", "sha"])


def dedup_bytes(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Rows of one id and text have equal results. Different texts of one id are separate documents.
    """
    docs = docs.select("doc_id", "text")
    copies = text_classes(docs, "suffix")
    spans = repeated_spans(docs, copies, length, k)
    cut = packed_texts(docs).join(copies, ["k1", "k2"], "left").where("rep is null or doc_id = rep").join(spans, ["doc_id", "k1"]).mapInArrow(_cut, "k1 long, k2 long, n_removed long, n_spans long, sha string").dropDuplicates(["k1", "k2"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_bytes") >= length)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    mine = lambda full, c, none: F.when(F.col("doc_id").isNull(), none).when(copy, full).otherwise(F.coalesce(c, none))
    both = whole.join(copies, ["k1", "k2"], "left").join(cut, ["k1", "k2"], "left")
    return both.select("doc_id", "n_bytes", mine(F.col("n_bytes"), "n_removed", zero).alias("n_removed"), mine(one, "n_spans", zero).alias("n_spans"), mine(F.sha2(F.lit(b""), 256), "sha", F.col("whole")).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(read(spark, sf_dir, "documents"))


# bytes as two hexadecimal digits each; windows of 50 bytes begin at p, runs of them that meet are spans
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100 AND doc_id IS NOT NULL)),
f AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
z AS (SELECT r, p FROM g JOIN f USING (g) WHERE m < doc_id),
o AS (SELECT r, p, p > 50 + lag(p, 1, -51) OVER (PARTITION BY r ORDER BY p) AS new FROM z),
i AS (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS i FROM o),
b AS (SELECT r, i, min(p) AS s, max(p) + 50 AS e FROM i GROUP BY r, i),
k AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS last FROM b),
x AS (SELECT r, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS e, string_agg(substr(h, 2 * last + 1, 2 * (s - last)), '' ORDER BY s) AS h FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(x.h, '') || substr(d.h, 2 * coalesce(x.e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""
