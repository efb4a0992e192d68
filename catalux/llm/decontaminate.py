"""Benchmark decontamination with a document-partitioned positional inverted index.

``build_index`` turns training texts into segments. A segment has its documents, a dictionary of its terms in
hash order, and each term's postings: word positions in the segment, as compressed differences. It is stored as a
table; segments are independent, so building and searching never shuffle, and a lost task loses a segment only.

``search`` looks up the terms of all item windows of a segment at once. A window with a term that the segment
lacks is dropped; for the others the offset-adjusted list of the rarest term is intersected with that of the next
rarest, and so on, in all windows at once, so that small segments cost little. With ``slop`` 0 matches are exact phrases; with more, each term may be that many words from its
place (proximity). Terms are compared as strings with the dictionary, not by hash alone.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Null and empty texts have
none. Null ``doc_id`` and repeated rows are documents like others. An item without words matches nothing; an
item of null ``item_id`` counts for the words that are hit, and has no id to list. Items are read by the executors in blocks of
about ``ITEM_BYTES``, however many there are. Very long texts are segments of their own. An empty table gives no rows, no
items no matches; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, LOWER, NOT_WORD, materialize, new_path, open_folder, read, text_steps, utf8, word_hash, words
from .windows import merge_spans, ranges

WINDOW = 10
SEGMENT_BYTES = 4 << 20
ITEM_BYTES = 32 << 20
#: Places of the rarest terms of windows that are looked at together.
STARTS = 1 << 19
INDEX = "segment string, docs array<long>, n_words array<int>, terms binary, postings binary"


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets, NOT_WORD)
    step = 1 << 18  # hashes are made in pieces that fit a cache
    h = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), step // 8):
        s, e = starts[i : i + step // 8], ends[i : i + step // 8]
        h[i : i + step // 8] = word_hash(raw[s[0] : e[-1]], s - s[0], e - s[0])
    return raw, starts, ends, first, h


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in text_steps(batches, SEGMENT_BYTES):
        raw, starts, ends, first, h = _terms(*utf8(b.column("text")))
        order = np.argsort(h, kind="stable")
        key = h[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        one = order[new]
        size = ends[one] - starts[one]
        head = np.array([len(new)], np.int64)
        terms = b"".join(x.tobytes() for x in (head, key[new], np.diff(np.append(new, len(key))).astype(np.int32), size.astype(np.int32), raw[ranges(starts[one], size)]))
        gap = np.diff(order.astype(np.int32), prepend=np.int32(0))
        gap[new] = order[new]
        planes = np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 4).T)
        n_words = pa.array(np.diff(first).astype(np.int32))
        pack = lambda x: pa.array([x])
        one_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield pa.RecordBatch.from_arrays([pack(uuid.uuid4().hex), one_list(b.column("doc_id")), one_list(n_words), pack(z.compress(terms)), pack(z.compress(planes.tobytes()))], ["segment", "docs", "n_words", "terms", "postings"])


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment; ``materialize`` or write it to search it more than once."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(_build, INDEX)


class Items:
    """Item windows: per window its item and terms; per distinct term its hash and string."""

    def __init__(self, rows: list[tuple[str, str]], window: int) -> None:
        self.ids = [i for i, _ in rows]
        raw, starts, ends, first, h = _terms(*utf8(pa.array([t or "" for _, t in rows], pa.string())))
        self.hash, one, of = np.unique(h, return_index=True, return_inverse=True)
        self.text = [raw[starts[i] : ends[i]].tobytes() for i in one]
        self.length, self.item, at = [], [], []
        for i in range(len(rows)):
            n = int(first[i + 1] - first[i])
            size = min(n, window)
            for j in range(n - size + 1) if n else ():
                self.item.append(i), self.length.append(size), at.append(first[i] + j)
        self.item, self.length = np.array(self.item, np.int64), np.array(self.length, np.int64)
        grid = np.array(at, np.int64).reshape(-1, 1) + np.minimum(np.arange(window), self.length.reshape(-1, 1) - 1)
        self.term = of[grid] if len(at) else np.zeros((0, window), np.int64)


def match(items: Items, terms: bytes, postings: bytes, doc_of: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of each match in a segment; ``doc_of`` has the document of each word."""
    none = np.zeros(0, np.int64)
    n = int(np.frombuffer(terms, np.int64, 1)[0])
    if not n or not len(items.term):
        return none, none
    key = np.frombuffer(terms, np.uint64, n, 8)
    count = np.frombuffer(terms, np.int32, n, 8 + 8 * n)
    size = np.frombuffer(terms, np.int32, n, 8 + 12 * n).astype(np.int64)
    begin = 8 + 16 * n + np.concatenate([[0], np.cumsum(size)])
    where = np.minimum(np.searchsorted(key, items.hash), n - 1)
    here = key[where] == items.hash
    for i in np.flatnonzero(here):
        here[i] = terms[begin[where[i]] : begin[where[i] + 1]] == items.text[i]
    freq = np.where(here, count[where], 0)
    alive = np.flatnonzero((freq[items.term] > 0).all(1))
    if not len(alive):
        return none, none
    gap = np.frombuffer(postings, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
    at = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
    # the lists of all terms that windows need, one after the other: (term, position) as one number each, in order
    term, length = items.term[alive], items.length[alive]
    used, local = np.unique(term, return_inverse=True)
    local = local.reshape(term.shape)
    n_list = count[where[used]].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(n_list)])
    step = gap[ranges(at[where[used]], n_list)].astype(np.int64)
    total = np.cumsum(step)
    place = total - np.repeat(total[begin[:-1]] - step[begin[:-1]], n_list)
    wide = len(doc_of) + 2 * (slop + term.shape[1] + 1)
    keyed = np.repeat(np.arange(len(used)), n_list) * wide + place + slop
    # rarest first; places beyond a shorter window's end come last and aren't looked at
    order = np.argsort(np.where(np.arange(term.shape[1]) < length.reshape(-1, 1), n_list[local], np.iinfo(np.int64).max), axis=1, kind="stable")
    local = np.take_along_axis(local, order, 1)
    sums = np.concatenate([[0], np.cumsum(n_list[local[:, 0]])])
    out_w, out_p, lo = [], [], 0
    while lo < len(alive):  # windows whose first lists have so many places together, or one
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + STARTS, side="right")) - 1)
        n_first = n_list[local[lo:hi, 0]]
        w = np.repeat(np.arange(lo, hi), n_first)
        start = place[ranges(begin[local[lo:hi, 0]], n_first)] - order[w, 0]
        ok = (start >= 0) & (start + length[w] <= len(doc_of))
        w, start = w[ok], start[ok]
        ok = doc_of[start] == doc_of[start + length[w] - 1]
        w, start = w[ok], start[ok]
        for r in range(1, term.shape[1]):
            if not len(w):
                break
            want = local[w, r] * wide + start + order[w, r]
            i = np.searchsorted(keyed, want)
            ok = (r >= length[w]) | ((i < len(keyed)) & (keyed[np.minimum(i, len(keyed) - 1)] <= want + 2 * slop))
            w, start = w[ok], start[ok]
        out_w.append(alive[w]), out_p.append(start)
        lo = hi
    return np.concatenate(out_w), np.concatenate(out_p)


FOUND = "segment string, no int, doc_id long, n_words long, n_hit long, matches array<struct<item_id: string, start: int, length: int>>"


def _search(files: tuple[str, ...], window: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, z = _load(files, window), zstandard.ZstdDecompressor()
        kind = pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
        for b in batches:
            for segment, docs, n_words, terms, postings in zip(*(b.column(x) for x in ("segment", "docs", "n_words", "terms", "postings")), strict=True):
                n = np.asarray(n_words.values, np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                doc_of = np.repeat(np.arange(len(n)), n)
                w, p = match(items, z.decompress(terms.as_py()), z.decompress(postings.as_py()), doc_of, slop)
                o = np.argsort(p, kind="stable")
                w, p = w[o], p[o]
                size = items.length[w] if len(w) else w
                hit = np.zeros(int(first[-1]) + 1, np.int64)
                s, e = merge_spans(p, np.minimum(p + size, first[doc_of[p] + 1]) if len(p) else p)
                hit[s] += 1
                np.add.at(hit, e, -1)
                total = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1])])
                cut = np.searchsorted(p, first)
                flat = pa.StructArray.from_arrays([pa.array([items.ids[i] for i in items.item[w]] if len(w) else [], pa.string()), pa.array((p - first[doc_of[p]]).astype(np.int32) if len(p) else [], pa.int32()), pa.array(size.astype(np.int32))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([pa.array([segment.as_py()] * len(n), pa.string()), pa.array(np.arange(len(n), dtype=np.int32)), docs.values, pa.array(n), pa.array(total[first[1:]] - total[first[:-1]]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat)], ["segment", "no", "doc_id", "n_words", "n_hit", "matches"])

    return run


def item_blocks(items: DataFrame) -> list[tuple[str, ...]]:
    """Files of the items in the shared folder, together those of about ``ITEM_BYTES``; executors read them, the driver doesn't.

    However many files a shuffle makes, there are no more blocks, each a pass over the texts, than the items' bytes need.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = new_path(spark, "items")
    items.repartition(int(size // ITEM_BYTES) + 1, "item_id", "text").write.parquet(folder)
    system, path = open_folder(folder)
    files = sorted((f"{folder}/{x.base_name}", x.size) for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet"))
    share = size / max(1, sum(n for _, n in files))  # bytes of text for each of a file
    blocks, full = [], math.inf
    for name, n in files:
        if full + n * share > ITEM_BYTES:
            blocks.append([])
            full = 0
        blocks[-1].append(name)
        full += n * share
    return [tuple(b) for b in blocks]


def _load(files: tuple[str, ...], window: int) -> Items:
    tables = []
    for file in files:
        system, path = open_folder(file)
        tables.append(pq.read_table(path, columns=["item_id", "text"], filesystem=system, partitioning=None))
    table = pa.concat_tables(tables)
    return Items(list(zip(*(table.column(c).to_pylist() for c in ("item_id", "text")), strict=True)), window)


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per indexed document: doc_id, n_words, n_hit and its matches (item_id as a string, first word, words).

    With several blocks of items the rows of a document, known by segment and number, are merged: the blocks' matches
    together, by first word, and the words in any of their spans. ``index`` must then be stored: segment ids are random.
    """
    parts = [index.mapInArrow(_search(files, window, slop), FOUND) for files in item_blocks(items)]
    if len(parts) == 1:
        return parts[0].drop("segment", "no")
    found = reduce(DataFrame.unionByName, parts).groupBy("segment", "no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    found = found.withColumn("matches", F.array_sort("matches", lambda a, b: a["start"] - b["start"]))
    # spans in order of their start: a word counts from where the last span ended
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(s: Column, m: Column) -> Column:
        end = F.least(m["start"].cast("long") + m["length"], F.col("n_words"))
        return F.struct((s["n"] + F.greatest(F.lit(0), end - F.greatest(s["end"], m["start"].cast("long")))).alias("n"), F.greatest(s["end"], end).alias("end"))

    return found.select("doc_id", "n_words", F.aggregate("matches", start, add)["n"].alias("n_hit"), "matches")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search(materialize(build_index(docs), "postings"), items, window)
    named = found.withColumn("items", F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull()))))
    return named.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def stage(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any window of an item, with the columns of ``documents``.

    Each step of texts is indexed, searched and filtered in one pass; blocks of items follow each other.
    """
    docs = docs.select(*DOC_COLUMNS)
    for files in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], files: tuple[str, ...] = files) -> Iterator[pa.RecordBatch]:
            known, z = _load(files, window), zstandard.ZstdDecompressor()
            for b in text_steps(batches, SEGMENT_BYTES):
                (segment,) = _build(iter([b.select(["doc_id", "text"])]))
                n = np.asarray(segment.column("n_words").values, np.int64)
                doc_of = np.repeat(np.arange(len(n)), n)
                _, p = match(known, z.decompress(segment.column("terms")[0].as_py()), z.decompress(segment.column("postings")[0].as_py()), doc_of, 0)
                clean = np.ones(b.num_rows, bool)
                clean[doc_of[p]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[p:p + least(len(w), 10) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, p, n, w[p:p + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM t, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h ON t.r = h.r LEFT JOIN k ON t.r = k.r
"""
