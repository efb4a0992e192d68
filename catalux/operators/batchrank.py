"""The k best assets of many queries at once, by the words of the ranked search (no vectors), and what a benchmark makes of them.

A row for each asset and query would be their product. Instead the posting lists that any of the queries needs are gathered once by
asset, and each task goes through its assets with all queries of a block in memory, keeping the k best of each: only these leave
the task. Each pair of near places of an asset is met once, for all queries of the block that ask for both terms: which ones is a bit
of each term for each query. So the work grows with the assets and their places, not with how many assets a query ranks alike.

Queries are parameters, like those of a single search: ``MOST_QUERIES`` at most, in blocks of ``BLOCK``. Ties go to the smaller asset id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import english
from . import fulltext
from .fulltext import FAR, FIELDS, LIMIT, SIMILAR, WEIGHT, SearchIndex

MOST_QUERIES = 10_000
BLOCK = 256
#: Assets whose ranks are computed together, and places of them.
ROWS = 256
PLACES = 1 << 18
TEXT_WEIGHT, NAME_WEIGHT = 0.20, 0.10
FIELD_WEIGHTS = dict(zip(FIELDS, (0.08, 0.07, 0.10), strict=True))
NEAR = np.array([0.0] + [WEIGHT * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))) for d in range(1, FAR + 1)])
LOG_FAR = np.log1p(-NEAR)
FREQUENT = np.append(0.0, np.cumsum(1 / np.arange(1, fulltext.MOST_POSITIONS + 1) ** 2)) * WEIGHT / LIMIT


@dataclass(frozen=True)
class Block:
    ids: list[int]
    texts: list[str]
    #: Numbers of the terms of each query, and of all terms.
    asked: list[list[int]]
    terms: list[str]


def blocks(terms: SearchIndex, queries: DataFrame) -> Iterator[Block]:
    """``queries``: query_id, q. Stems of all words are made at once."""
    rows = sorted((r.query_id, (r.q or "").strip()) for r in queries.select("query_id", "q").limit(MOST_QUERIES + 1).collect())
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    words = {w for _, q in rows for w in re.split(r"[\W_]+", q.lower()) if w} - set(english.STOP_WORDS)
    stem = {r.word: r.term for r in english.stemmed(terms.spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()} if words else {}
    for i in range(0, len(rows), BLOCK):
        part = rows[i : i + BLOCK]
        found = [sorted({stem[w] for w in re.split(r"[\W_]+", q.lower()) if w in stem}) for _, q in part]
        every = sorted({t for f in found for t in f})
        number = {t: k for k, t in enumerate(every)}
        yield Block([r[0] for r in part], [r[1] for r in part], [[number[t] for t in f] for f in found], every)


def _candidates(assets: DataFrame, terms: SearchIndex, block: Block) -> DataFrame:
    """asset_id, file_name, found (term number, positions) and, per field, the numbers of the queries that its value is similar to."""
    spark = terms.spark
    numbers = spark.createDataFrame(list(zip(block.terms, range(len(block.terms)), strict=True)), "term string, no int")
    lists = terms._read("terms", "term", block.terms).join(F.broadcast(numbers), "term")  # as many as the block has terms
    found = lists.groupBy("asset_id").agg(F.collect_list(F.struct("no", "positions")).alias("found"))
    grams = [(g, k, len(s)) for k, q in enumerate(block.texts) for s in [fulltext._trigrams(q)] for g in s]
    asked = spark.createDataFrame(grams, "gram string, query int, m int")
    values = terms._read("values", "gram", sorted({g[0] for g in grams})).join(F.broadcast(asked), "gram").where((F.col("n") * SIMILAR <= F.col("m")) & (F.col("n") >= F.col("m") * SIMILAR))
    shared = values.groupBy("field", "value", "n", "query", "m").agg(F.count("*").alias("hits")).where(F.col("hits") / (F.col("n") + F.col("m") - F.col("hits")) >= SIMILAR)
    near = shared.groupBy("field", "value").agg(F.collect_list("query").alias("queries"))  # of one block
    fields = spark.read.parquet(f"{terms.folder}/assigned").join(near, ["field", "value"]).groupBy("asset_id").agg(*[F.first(F.when(F.col("field") == f, F.col("queries")), ignorenulls=True).alias(f) for f in FIELDS])
    return assets.select("asset_id", F.lower("file_name").alias("file_name")).join(found, "asset_id", "left").join(fields, "asset_id", "left").select("asset_id", "file_name", "found", *FIELDS)


def pair_rank(places: np.ndarray, term: np.ndarray) -> float:
    """Rank of places of two terms or more (``fulltext.rank``)."""
    order = np.argsort(places, kind="stable")
    places, term = places[order], term[order]
    left, d = 0.0, 1
    while d < len(places):
        gap = places[d:] - places[:-d]
        near = gap <= FAR
        if not near.any():
            break
        gap = gap[near & (term[d:] != term[:-d]) & (gap > 0)]
        left += float(np.log1p(-NEAR[gap]).sum())
        d += 1
    return -math.expm1(left)


def query_bits(asked: list[list[int]], terms: int) -> np.ndarray:
    """Of each term the queries that ask for it among others, as bits of 64-bit words."""
    words = (len(asked) + 63) // 64
    bits = np.zeros((terms, 64 * words), np.uint8)
    for i, a in enumerate(asked):
        if len(a) > 1:
            bits[a, i] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def pair_sums(doc: np.ndarray, term: np.ndarray, place: np.ndarray, bits: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Of each document and query the sum of ``log1p(-NEAR)`` over the pairs of places of two of its terms.

    Every pair of near places is met once, for all queries that ask for both terms, so the work is a document's places times those
    within ``FAR`` words, whatever ranks come out.
    """
    left = np.zeros(shape[0] * shape[1])
    some = bits[term].any(1)
    doc, term, place = doc[some], term[some], place[some]
    order = np.lexsort((place, doc))
    doc, term, place = doc[order], term[order], place[order]
    first = np.searchsorted(doc, np.arange(shape[0] + 1))
    at = 0
    while at < shape[0]:  # whole documents, with so many places together
        to = max(at + 1, int(np.searchsorted(first, first[at] + PLACES, side="right")) - 1)
        d, t = doc[first[at] : first[to]], term[first[at] : first[to]]
        p = place[first[at] : first[to]] + d * (2 * fulltext.LAST_POSITION)  # places of two documents are far
        i, step = np.arange(len(p)), 1
        while len(i := i[i + step < len(p)]):
            gap = p[i + step] - p[i]
            i, gap = i[gap <= FAR], gap[gap <= FAR]
            both = bits[t[i]] & bits[t[i + step]]
            hit = np.flatnonzero(both.any(1) & (gap > 0) & (t[i] != t[i + step]))
            if len(hit):
                row, query = np.nonzero(np.unpackbits(both[hit].view(np.uint8), axis=1, bitorder="little"))
                left += np.bincount(d[i[hit]][row] * shape[1] + query, LOG_FAR[gap[hit]][row], len(left))
            step += 1
        at = to
    return left.reshape(shape)


def best(candidates: DataFrame, block: Block, k: int) -> DataFrame:
    """query_id, asset_id, raw: of each task the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, t = len(block.ids), max(1, len(block.terms))
        bits = query_bits(block.asked, t)
        alone = [(i, a[0]) for i, a in enumerate(block.asked) if len(a) == 1]
        low = [x.lower() for x in block.texts]
        short = [i for i, x in enumerate(low) if x]
        none = np.iinfo(np.int64).max
        top, owner = np.full((k, q), -np.inf), np.full((k, q), none)  # best first
        for big in batches:
            for o in range(0, big.num_rows, ROWS):
                b = big.slice(o, ROWS)
                rows, found = b.num_rows, b.column("found")
                row = np.repeat(np.arange(rows), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                no, places = found.flatten().flatten()
                no, size = no.to_numpy(zero_copy_only=False).astype(np.int64), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                n = np.zeros((rows, t), np.int64)
                n[row, no] = size
                raw = np.zeros((rows, q))
                for f in FIELDS:
                    near = b.column(f)
                    np.add.at(raw, (np.repeat(np.arange(rows), near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), near.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), FIELD_WEIGHTS[f])
                for r, name in enumerate(b.column("file_name").to_pylist()):
                    for i in short if name else ():
                        if len(low[i]) <= len(name) and low[i] in name:
                            raw[r, i] += NAME_WEIGHT
                for i, a in alone:
                    raw[:, i] += TEXT_WEIGHT * FREQUENT[n[:, a]]
                left = pair_sums(np.repeat(row, size), np.repeat(no, size), places.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bits, (rows, 64 * bits.shape[1]))
                raw += TEXT_WEIGHT * -np.expm1(left[:, :q])
                raw = np.vstack([top, np.floor(raw * 1e9 + 0.5) / 1e9])
                ids = np.vstack([owner, np.broadcast_to(b.column("asset_id").fill_null(none).to_numpy(zero_copy_only=False).reshape(-1, 1), (rows, q))])
                order = np.lexsort((ids, -raw), axis=0)[:k]
                top, owner = np.take_along_axis(raw, order, 0), np.take_along_axis(ids, order, 0)
        flat = [(block.ids[i], None if a == none else a, s) for i in range(q) for s, a in zip(top[:, i].tolist(), owner[:, i].tolist(), strict=True) if s > -np.inf]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.float64())], ["query_id", "asset_id", "raw"])

    return candidates.mapInArrow(run, "query_id long, asset_id long, raw double")


def top_assets(queries: DataFrame, assets: DataFrame, terms: SearchIndex, k: int = 3) -> DataFrame:
    """query_id, place (1 to k), asset_id, raw. ``assets``: asset_id, file_name, the active ones. Texts without a score come by id."""
    out = None
    for block in blocks(terms, queries):
        found = best(_candidates(assets, terms, block), block, k)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return terms.spark.createDataFrame([], "query_id long, place int, asset_id long, raw double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "asset_id"))
    return out.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "asset_id", "raw")


def benchmark(queries: DataFrame, top: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, type, expected_rank, passed: the first place of an expected asset (query_id, asset_id); no verdict without any."""
    hit = top.join(expected, ["query_id", "asset_id"], "left_semi").groupBy("query_id").agg(F.min("place").alias("expected_rank"))
    some = expected.select("query_id").distinct().withColumn("some", F.lit(True))
    out = queries.select("query_id", "type").join(hit, "query_id", "left").join(some, "query_id", "left")
    return out.select("query_id", "type", "expected_rank", F.when(F.col("some"), F.col("expected_rank").isNotNull()).alias("passed"))


def by_type(results: DataFrame) -> DataFrame:
    """type, passed, total: counts over the queries that have a verdict."""
    return results.where("passed is not null").groupBy("type").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count("*").alias("total"))


def ranks_sql(texts: str, queries: str, name: str) -> str:
    """DuckDB: common table expressions, the last called ``name`` with query_id, asset_id, text_rank, over ``queries`` (query_id, q)."""
    stop = ", ".join(f"'{w}'" for w in english.STOP_WORDS)
    split = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    near = f"{WEIGHT} * sqrt(1 / (1.005 + 0.05 * exp(abs(x.p - y.p) / 1.5 - 2)))"
    return f"""
{name}_places AS (SELECT asset_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM (SELECT asset_id, {split.format("searchable_text")} AS w FROM {texts})),
{name}_asked AS (SELECT DISTINCT query_id, unnest({split.format("q")}) AS word FROM {queries}),
{name}_words AS (SELECT word FROM (SELECT word FROM {name}_places UNION SELECT word FROM {name}_asked) WHERE word NOT IN ({stop})),
{english.stem_sql(f"{name}_words", f"{name}_stems")},
{name}_wanted AS MATERIALIZED (SELECT DISTINCT query_id, term FROM {name}_asked JOIN {name}_stems USING (word)),
{name}_sizes AS (SELECT query_id, count(*) AS n FROM {name}_wanted GROUP BY query_id),
{name}_found AS (SELECT DISTINCT asset_id, term, least(p, {fulltext.LAST_POSITION}) AS p FROM {name}_places JOIN {name}_stems USING (word) WHERE term IN (SELECT term FROM {name}_wanted)),
{name}_kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id, term ORDER BY p) AS i FROM {name}_found QUALIFY i <= {fulltext.MOST_POSITIONS}),
{name}_one AS (SELECT query_id, asset_id, sum(1 / (i * i)) * {WEIGHT} / {LIMIT} AS r FROM {name}_kept JOIN {name}_wanted USING (term) JOIN {name}_sizes USING (query_id) WHERE n = 1 GROUP BY ALL),
{name}_both AS MATERIALIZED (SELECT x.asset_id, x.term AS s, y.term AS t, sum(ln(1 - {near})) AS r FROM {name}_kept x JOIN {name}_kept y ON x.asset_id = y.asset_id AND x.term < y.term AND x.p <> y.p AND abs(x.p - y.p) <= {FAR} GROUP BY ALL),
{name}_more AS (SELECT a.query_id, asset_id, 1 - exp(sum(r)) AS r FROM {name}_wanted a JOIN {name}_wanted b ON a.query_id = b.query_id AND a.term < b.term JOIN {name}_both ON s = a.term AND t = b.term GROUP BY ALL),
{name} AS (SELECT query_id, asset_id, r AS text_rank FROM {name}_one UNION ALL SELECT query_id, asset_id, r FROM {name}_more)
"""
