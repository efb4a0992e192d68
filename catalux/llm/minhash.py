"""MinHash near-dedup: universal hash minima, banding, verification on full sets, components.

1. Each document becomes the set of its distinct word shingles (64-bit hashes). Documents of equal sets are
   linked by a 128-bit fingerprint of the set; the least of each such class goes on.
2. ``bands * rows`` multiply-add hash minima, in bands. With 20 bands of 4 rows a pair at similarity 0.85
   is missed with probability 4e-7; at 0.8, 3e-5 (use 32 bands there).
3. In each bucket every document is verified against the least one. Components of these links come next.
4. Buckets that still hold more than one component are settled exactly: all their pairs of different
   components are looked at, each pair in one of the buckets it has in common, the likely ones (by signature) are
   compared on full sets, and only links that join components are returned. So no pair within a bucket is left out and
   none is emitted. A bucket goes to one group up to ``BLOCK`` documents and ``BLOCK_BYTES`` of text; of a larger
   one the documents of its largest component meet the others in blocks, never each other, and a task never holds
   more than two blocks. Documents meet their texts before they are dealt to blocks.
5. Components by alternating large-star and small-star.

Null or empty text: an empty set, linked with nothing. Null ``doc_id``: linked with nothing, component null,
kept. Rows of one id that have shingles are one node: they share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, LOWER, SPACE, materialize, mix, read, release, span_hash, text_steps, utf8, window_hash, word_hash, words
from .components import connected_components
from .windows import packed_texts

BANDS, ROWS = 20, 4
BLOCK = 2048
BLOCK_BYTES = 8 << 20
#: A pair is compared on full sets if at least this share of its minima agrees; links have 0.85 on average.
LIKELY = 0.6


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, not yet distinct, and the n + 1 offsets of the texts."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets, SPACE)
    w = word_hash(raw, starts, ends)
    n = np.diff(first)
    each = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    h = np.append(window_hash(w, size), np.zeros(min(len(w), size - 1), np.uint64))
    at = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(int(at[-1]), np.uint64)
    have = np.flatnonzero(each)
    if len(have):
        where = np.ones(len(out), np.int64)
        where[0] = first[have[0]]
        where[at[have[1:]]] = first[have[1:]] - first[have[:-1]] - each[have[:-1]] + 1
        out = h[np.cumsum(where)]
        few = np.flatnonzero((n > 0) & (n < size))
        out[at[few]] = span_hash(w, first[few], first[few + 1])
    return out, at


def multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, sig binary, keys array<long>, n_bytes long"


def _sign(size: int, bands: int, rows: int, seed: int):
    a, b = multipliers(bands * rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches):
            h, at = shingles(batch.column("text"), size)
            n = batch.num_rows
            doc = np.repeat(np.arange(n), np.diff(at))
            o = np.lexsort((h, doc))
            h, doc = h[o], doc[o]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            count = np.bincount(doc, minlength=n)
            have = np.flatnonzero(count)
            f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig = np.zeros((n, bands * rows), np.uint64)
            if len(have):
                begin = np.concatenate([[0], np.cumsum(count[have])[:-1]])
                f1[have] = np.add.reduceat(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), begin)
                f2[have] = np.add.reduceat(mix(h ^ np.uint64(0x9E6C63D0876A9A47)), begin)
                for i in range(bands * rows):
                    sig[have, i] = np.minimum.reduceat(h * a[i] + b[i], begin)
            band = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows] + np.arange(bands, dtype=np.uint64))
            short = (sig >> np.uint64(48)).astype(np.uint16)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]), pa.int32()), pa.array(band[count > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([x.tobytes() for x in short], pa.binary()), keys, pa.array(np.diff(utf8(batch.column("text"))[1]))],
                ["doc_id", "n_shingles", "f1", "f2", "sig", "keys", "n_bytes"],
            )

    return run


class _Sets:
    """Shingle sets of packed texts; the last few stay."""

    def __init__(self, size: int) -> None:
        self.size, self.kept, self.z = size, {}, zstandard.ZstdDecompressor()

    def get(self, key: tuple, packed: bytes) -> np.ndarray:
        if key not in self.kept:
            if len(self.kept) > 64:
                self.kept.clear()
            text = self.z.decompress(packed)
            self.kept[key] = np.unique(shingles(pa.array([text], pa.binary()), self.size)[0])
        return self.kept[key]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    i = np.searchsorted(large, small)
    both = int((large[np.minimum(i, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(size)
        for b in batches:
            c = [b.column(x).to_pylist() for x in ("u", "v", "ku", "kv", "pu", "pv")]
            hit = [(u, v) for u, v, ku, kv, pu, pv in zip(*c, strict=True) if similar(sets.get((u, ku), pu), sets.get((v, kv), pv), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hit], pa.int64()), pa.array([x[1] for x in hit], pa.int64())], ["u", "v"])

    return run


def _settle(size: int, percent: int, bands: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between different components of two blocks of a bucket (or within one)."""
        key, i, j = (table.column(x)[0].as_py() for x in ("key", "i", "j"))
        ids, block, label = (np.asarray(table.column(x)) for x in ("doc_id", "block", "label"))
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        packed = table.column("packed").to_pylist()
        sets: dict[int, np.ndarray] = {}
        z = zstandard.ZstdDecompressor()

        def of(x: int) -> np.ndarray:
            if x not in sets:
                if len(sets) > 2 * BLOCK:
                    sets.clear()
                sets[x] = np.unique(shingles(pa.array([z.decompress(packed[x])], pa.binary()), size)[0])
            return sets[x]

        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        least = int(LIKELY * sig.shape[1])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for x in left.tolist():
            others = right[(label[right] != label[x]) & ((right > x) if i == j else True)]
            if not len(others):
                continue
            others = others[(sig[others] == sig[x]).sum(1) >= least]
            # of the buckets that hold both, all of them mixed, the one of the least key compares them
            first = np.where(keys[others] == keys[x], keys[x], np.iinfo(np.int64).max).min(1)
            for y in others[first == key].tolist():
                a, b = find(int(label[x])), find(int(label[y]))
                if a != b and similar(of(x), of(y), percent):
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[x]), int(ids[y])))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return run


def mixed_buckets(labelled: DataFrame) -> DataFrame:
    """(key, top, n_top, n_rest) of buckets with several labels: the label of most documents, and the blocks of its documents and of the others.

    Of buckets of equal members only the one of the least key is there. Where all fit in one block, ``n_rest`` is 0.
    """
    h = F.xxhash64("doc_id", "f1").cast("decimal(20,0)")
    part = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"), F.sum(h).alias("s"))
    whole = part.groupBy("key").agg(F.max(F.struct("n", "bytes", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("m"), F.sum("bytes").alias("bytes"), F.sum("s").alias("s")).where("labels > 1")
    one = whole.groupBy("m", "s").agg(F.min_by(F.struct("key", "top", "m", "bytes"), "key").alias("x")).select("x.*")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    small = blocks(F.col("m"), F.col("bytes")) <= 1
    rest = blocks(F.col("m") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))
    return one.select("key", F.col("top.label").alias("top"), F.when(small, 1).otherwise(blocks(F.col("top.n"), F.col("top.bytes"))).alias("n_top"), F.when(small, 0).otherwise(F.greatest(rest, F.lit(1))).alias("n_rest"))


def in_blocks(member: DataFrame) -> DataFrame:
    """The rows of ``member`` with block, i and j: blocks of the largest label are numbered first, and meet those of the others only."""
    n_top, n_rest = F.col("n_top"), F.col("n_rest")
    mine = (n_rest == 0) | (F.col("label") == F.col("top"))
    hashed = F.xxhash64("doc_id", F.lit(1))
    dealt = member.withColumn("block", F.when(mine, F.pmod(hashed, n_top)).otherwise(n_top + F.pmod(hashed, F.greatest(n_rest, F.lit(1)))).cast("int"))
    meets = F.when(n_rest == 0, F.array(F.lit(0))).when(mine, F.sequence(n_top, n_top + n_rest - 1)).otherwise(F.sequence(F.lit(0), n_top + n_rest - 1))
    pair = F.explode(F.transform(meets, lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"))))
    return dealt.withColumn("p", pair).select("key", "doc_id", "label", "block", "sig", "keys", "packed", "p.i", "p.j")


def _links_of_one_id(live: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): the least document of each class that an id of several sets is in, and that id."""
    own = ["n_shingles", "f1", "f2"]
    several = live.groupBy("doc_id").agg(F.min(F.xxhash64(*own)).alias("a"), F.max(F.xxhash64(*own)).alias("b")).where("a < b").select("doc_id")
    sets = live.select("doc_id", *own).join(several, "doc_id").join(classes.select("rep", *own), own)
    return sets.where("rep <> doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept. See the module's text."""
    spark = docs.sparkSession
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = materialize(rows_of.mapInArrow(_sign(size, bands, rows, seed), SIGNED), "minhash")
    live = signed.where("doc_id is not null and n_shingles > 0")
    classes = live.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sig", "keys", "n_bytes"), "doc_id").alias("x"))
    classes = materialize(classes.select("n_shingles", "f1", "f2", "rep", "x.sig", "x.keys", "x.n_bytes"), "minhash-classes")
    buckets = classes.select(F.col("rep").alias("doc_id"), "f1", "n_bytes", F.explode("keys").alias("key"))
    pivot = buckets.groupBy("key").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("last")).where("u < last").select("key", "u")
    shared = materialize(buckets.join(pivot, "key"), "minhash-buckets")  # only documents that share a bucket
    pairs = shared.where("u <> doc_id").select("u", F.col("doc_id").alias("v")).distinct()
    texts = packed_texts(docs)
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("k1").alias(f"k{x}"), F.col("packed").alias(f"p{x}"))
    found = pairs.join(side("v"), "v").join(side("u"), "u").mapInArrow(_verify(size, percent), "u long, v long")
    links = materialize(found.unionByName(_links_of_one_id(live, classes)), "minhash-links")
    del pairs
    release(spark)
    comp = materialize(connected_components(links), "minhash-components")

    labelled = shared.select("key", "doc_id", "f1", "n_bytes").join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    mixed = materialize(mixed_buckets(labelled), "minhash-mixed")
    if not mixed.isEmpty():
        rep = classes.select(F.col("rep").alias("doc_id"), "f1", "sig", "keys")
        member = labelled.join(mixed, "key").join(rep, ["doc_id", "f1"]).join(texts, "doc_id")
        more = in_blocks(member).groupBy("key", "i", "j").applyInArrow(_settle(size, percent, bands), "u long, v long")
        more = materialize(more, "minhash-links")
        comp = materialize(connected_components(links.unionByName(more)), "minhash-components")
    named = classes.select("n_shingles", "f1", "f2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    node = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return node.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    docs = docs.select(*DOC_COLUMNS)
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85, over all of ``documents``."""
    return near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85, bands=BANDS)


# links by the shingles in common, then all that is reachable over links: small tables only
OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM t WHERE len(w) > 0)),
n AS (SELECT r, doc_id, coalesce(n, 0) AS n FROM t LEFT JOIN (SELECT r, count(*) AS n FROM s GROUP BY r) USING (r)),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN n x ON x.r = c.a JOIN n y ON y.r = c.b WHERE 100 * k >= 85 * (x.n + y.n - k) AND x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
q AS (SELECT a, b FROM e UNION SELECT q.a, e.b FROM q JOIN e ON q.b = e.a),
m AS (SELECT a, least(a, min(b)) AS m FROM q GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CAST(coalesce(m, doc_id) AS BIGINT) AS component_id, coalesce(doc_id = coalesce(m, doc_id), true) AS kept FROM n LEFT JOIN m ON n.doc_id = m.a AND n > 0
"""
