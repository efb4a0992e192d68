"""Substring dedup on a de Bruijn graph of words.

The edges of the graph are the windows of ``length`` words. Edges in a row with
one minimizer form a *super-edge* (a run, see ``windows``); only super-edges
whose minimizer occurs in two documents or more are built.

1. Each occurrence of such a super-edge gives its minimizer, a 128-bit digest of its words,
   its coordinates, its neighbours in the text, and the hashes of its edges.
2. Super-edges of equal content are aggregated to one node, with the least source
   coordinate (document, word). A minimizer with one content only doesn't branch.
3. Nodes that follow each other alone, with the same source text and adjoining
   source coordinates, are compacted to paths by pointer doubling through joins.
   A path is judged as a whole, at its head: an occurrence is removed if the path's source is a smaller document. Its
   words are those at the source coordinate, as the digests of all its super-edges are.
4. Branching super-edges fall apart into edges. Each edge is aggregated to its least
   document and joined back to its occurrences.
5. Spans meet the texts by document and the kept words are hashed. Texts are shuffled in step 1 and here, once each.

All grouping is by aggregates with map-side combination and by joins that Spark
can split where they are skewed. Null or empty text: no words. Null ``doc_id``:
kept whole. Documents of fewer than ``length`` words are kept whole. Rows of one
id and text have equal results; different texts of one id are separate documents, which do not remove each other. Very long
texts are looked at whole. No rows: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, M64, materialize, read, release, window_hash
from .windows import listed, merge_spans, packed_texts, ranges, runs, symbols, text_classes, unpacked, with_shared

LENGTH = 50
K = 20
BASE2 = (BASE * 0xD1342543DE82EF95 | 1) & M64
OCCURRENCE = "h long, c binary, doc_id long, k1 long, start int, n int, prv binary, nxt binary, edges array<long>"
NAMES = [x.split()[0] for x in OCCURRENCE.split(", ")]
#: In place of the digest of a neighbour.
NONE = b""


def _occurrences(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, k1, texts, shared, _ in unpacked(batches):
            texts = pa.array([b" ".join(x.split()) for x in texts.to_pylist()], pa.binary())  # the same words
            s, offsets, (raw, starts, ends) = symbols(texts, "word")
            doc, first, count, h = runs(s, offsets, length, k)
            ok = listed(doc, h, *shared)
            doc, first, count, h = doc[ok], first[ok], count[ok], h[ok]
            if not len(doc):
                continue
            raw = raw.tobytes()
            c = [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(starts[first].tolist(), ends[first + count + length - 2].tolist(), strict=True)]
            follows = (doc[1:] == doc[:-1]) & (first[1:] == first[:-1] + count[:-1])
            prv = [NONE] + [x if f else NONE for x, f in zip(c[:-1], follows.tolist(), strict=True)]
            nxt = [x if f else NONE for x, f in zip(c[1:], follows.tolist(), strict=True)] + [NONE]
            edges = window_hash(s, length, BASE2)[ranges(first, count)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(edges))
            longs = [h.view(np.int64), ids[doc], k1[doc], (first - offsets[doc]).astype(np.int32), count.astype(np.int32)]
            cols = [*map(pa.array, longs), *(pa.array(x, pa.binary()) for x in (c, prv, nxt)), lists]
            yield pa.RecordBatch.from_arrays(cols, ["h", "doc_id", "k1", "start", "n", "c", "prv", "nxt", "edges"]).select(NAMES)

    return run


def nodes(occurrences: DataFrame) -> DataFrame:
    """One row per super-edge content: least source coordinate, neighbours if unique, and whether its minimizer branches."""
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(NONE))
    node = occurrences.groupBy("h", "c").agg(
        F.min(F.struct("doc_id", "k1", "start")).alias("src"), F.max("n").alias("n"), same("prv").alias("prv"), same("nxt").alias("nxt")
    )
    minimizer = node.groupBy("h").agg((F.count("*") > 1).alias("branches"))
    return node.join(minimizer, "h").select("h", "c", F.col("src.doc_id").alias("src_doc"), F.col("src.k1").alias("src_k1"), F.col("src.start").alias("src_start"), "n", "prv", "nxt", "branches")


def compact(node: DataFrame, length: int) -> DataFrame:
    """(c, src_doc, src_k1, src_start, words) of each nonbranching path: its first node, its source coordinate, its length.

    ``up`` points to the node before, if each is the other's only neighbour and their sources adjoin; joins
    double it until every node points to the head of its path. Source positions rise along a path, so there
    are no cycles. As all occurrences of a node of a path go on to the next one, wherever the head is the whole path is.
    """
    plain = node.where("not branches")
    source = ["src_doc", "src_k1"]
    a = plain.select(F.col("c").alias("up"), F.col("nxt").alias("c"), *[F.col(x).alias(f"up_{x}") for x in source], (F.col("src_start") + F.col("n")).alias("at")).where("octet_length(c) > 0")
    link = plain.join(a, "c").where("prv = up and src_doc = up_src_doc and src_k1 = up_src_k1 and src_start = at").select("c", "up")
    path = plain.select("c", *source, "src_start", "n").join(link, "c", "left").select("c", F.coalesce("up", "c").alias("up"), *source, "src_start", "n")
    path = materialize(path, "substring-path")
    before = -1
    while True:
        heads = path.where("up = c").select(F.col("c").alias("head"), F.lit(0).cast("long").alias("root"))
        open_ = path.join(heads.select(F.col("head").alias("up")), "up", "left_anti").count()
        if open_ == 0 or open_ == before:
            break
        before = open_
        step = path.select(F.col("c").alias("up"), F.col("up").alias("up2"))
        path = materialize(path.join(step, "up").select("c", F.col("up2").alias("up"), *source, "src_start", "n"), "substring-path")
    whole = path.groupBy("up").agg(F.min("src_doc").alias("src_doc"), F.min("src_k1").alias("src_k1"), F.min("src_start").alias("src_start"), (F.sum("n") + length - 1).cast("int").alias("words"))
    return whole.withColumnRenamed("up", "c")


def repeated_words(docs: DataFrame, copies: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, k1, start, end): removed word spans; they may overlap or touch."""
    spark = docs.sparkSession
    texts, _ = with_shared(docs, copies, "word", length, k, "substring")
    occ = materialize(texts.mapInArrow(_occurrences(length, k), OCCURRENCE), "substring-edges")
    release(spark)
    node = materialize(nodes(occ), "substring-nodes")
    paths = materialize(compact(node, length), "substring-paths")
    release(spark)
    heads = occ.select("c", "doc_id", "k1", "start").join(paths.select("c", "src_doc", "words"), "c").where("src_doc < doc_id")
    whole = heads.select("doc_id", "k1", "start", (F.col("start") + F.col("words")).alias("end"))
    forked = occ.join(node.where("branches").select("h", "c"), ["h", "c"]).select("h", "doc_id", "k1", "start", F.posexplode("edges").alias("i", "e"))
    least = forked.groupBy("h", "e").agg(F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("hi")).where("src_doc < hi").drop("hi")
    at = F.col("start") + F.col("i")
    edges = forked.join(least, ["h", "e"]).where("src_doc < doc_id").select("doc_id", "k1", at.alias("start"), (at + length).alias("end"))
    return whole.unionByName(edges)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        removed, digest = [], []
        for packed, spans in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words = z.decompress(packed).split()
            pair = np.minimum(np.array([(x["start"], x["end"]) for x in spans], np.int64).reshape(-1, 2), len(words))
            start, end = merge_spans(pair[:, 0], pair[:, 1])
            kept, at = [], 0
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                kept += words[at:s]
                at = e
            kept += words[at:]
            removed.append(len(words) - len(kept)), digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "k1", "k2")), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "k1", "k2", "n_removed", "sha"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [x.encode().split() for x in b.column("text").to_pylist()]  # bytes split on exactly the contract's six characters
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "k1", "k2")), pa.array(map(len, words), pa.int64()), pa.array((hashlib.sha256(b" ".join(x)).hexdigest() for x in words), pa.string())], ["doc_id", "k1", "k2", "n_words", "whole"])


def dedup_words(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select("doc_id", "text")
    copies = text_classes(docs, "substring")
    spans = repeated_words(docs, copies, length, k).groupBy("doc_id", "k1").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = materialize(spans, "substring-spans")
    release(docs.sparkSession)
    cut = packed_texts(docs).join(spans, ["doc_id", "k1"]).mapInArrow(_cut, "doc_id long, k1 long, k2 long, n_removed long, sha string")
    cut = cut.join(copies, ["k1", "k2"], "left").where("rep is null or doc_id = rep").select("k1", "k2", "n_removed", "sha").dropDuplicates(["k1", "k2"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text")).mapInArrow(_whole, "doc_id long, k1 long, k2 long, n_words long, whole string")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= length)
    zero = F.lit(0).cast("long")
    mine = lambda full, c, none: F.when(F.col("doc_id").isNull(), none).when(copy, full).otherwise(F.coalesce(c, none))
    both = whole.join(copies, ["k1", "k2"], "left").join(cut, ["k1", "k2"], "left")
    return both.select("doc_id", "n_words", mine(F.col("n_words"), "n_removed", zero).alias("n_removed"), mine(F.sha2(F.lit(b""), 256), "sha", F.col("whole")).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, p, array_to_string(w[p:p + 49], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
f AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
l AS (SELECT r, list(DISTINCT q) AS qs FROM (SELECT r, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (g) WHERE m < doc_id) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(coalesce(qs, []), x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (r)
"""
