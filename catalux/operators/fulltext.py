"""Inverted indexes of search: stemmed terms with positions, trigrams of field values and of file names.

An index is a folder of four tables. Postings are sorted and cut into ``shards`` by term, so that a query reads the shards of its own
terms only (folders that the plan leaves out) and, within them, the row groups whose range holds a term.

* ``terms``: shard, term, asset_id, positions. A term is a stem (``functions.english``); stop words have no postings but count as
  positions. As in a database's text vector, positions stop at ``LAST_POSITION`` and a term keeps its first ``MOST_POSITIONS``.
* ``values``: shard, gram, field, value, n. Trigrams of the *distinct* values of each field (n: how many a value has), so that a value
  that a third of all assets share is one entry. ``assigned``: asset_id, field, value.
* ``names``: shard, gram, asset_id, file_name (lower case).

Words are runs of letters and digits; hyphenated words, addresses and numbers with a point fall into their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import english, text

LAST_POSITION = 16383
MOST_POSITIONS = 256
#: Bytes of words that a task turns into postings at a time.
STEP_BYTES = 4 << 20
#: Texts of an Arrow batch, a few MB.
BATCH_ROWS = 1000
SHARDS = 64
#: Weight of a term without a label, and the limit of the sum of 1/i**2: fixed by the rank's definition.
WEIGHT = 0.1
LIMIT = 1.64493406685
#: Beyond this many words a pair of terms no longer counts.
FAR = 100
SIMILAR = 0.3
FIELDS = ("treatment", "subject", "doctor_name")


def terms(c):
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, positions of each term of a text, from the lists of its words: key, words."""
    stop, known = frozenset(english.STOP_WORDS), lru_cache(1 << 18)(english.stem)
    for big in batches:
        each = max(1, int(STEP_BYTES // max(1, big.nbytes / max(1, big.num_rows))))
        for at in range(0, big.num_rows, each):
            b = big.slice(at, each)
            lists = b.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            stems = [None if w in stop else known(w) for w in coded.dictionary.to_pylist()]
            names = pa.array(stems, pa.string()).dictionary_encode()
            of = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = of[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(n)), n)
            place = np.minimum(np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n) + 1, LAST_POSITION)
            row, term, place = (x[term >= 0] for x in (row, term, place))
            order = np.argsort(row * max(1, len(names.dictionary)) + term, kind="stable")  # places are in order
            row, term, place = row[order], term[order], place[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
            once = new.copy()
            once[1:] |= place[1:] != place[:-1]
            row, term, place, new = row[once], term[once], place[once], new[once]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(row)))
            short = np.arange(len(row)) - np.repeat(start, size) < MOST_POSITIONS
            size = np.minimum(size, MOST_POSITIONS)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row[start])), names.dictionary.take(pa.array(term[start])), pa.ListArray.from_arrays(offsets, pa.array(place[short].astype(np.int32)))],
                [b.schema.names[0], "term", "positions"],
            )


def postings(texts: DataFrame, key: str = "asset_id", c: str = "searchable_text") -> DataFrame:
    """key, term, positions of every text.

    Each text is a row of its own, so its postings are made where it is read, and no place of a word is shuffled; only where keys
    repeat are the places of a key's texts put together.
    """
    kind = dict(texts.dtypes)[key]
    found = texts.select(key, terms(F.col(c)).alias("words")).mapInArrow(_places, f"`{key}` {kind}, term string, positions array<int>")
    if texts.groupBy(key).count().where("count > 1").isEmpty():
        return found
    found = found.select(key, "term", F.explode("positions").alias("place")).groupBy(key, "term").agg(F.collect_set("place").alias("positions"))  # at most LAST_POSITION numbers a text
    return found.withColumn("positions", F.slice(F.array_sort("positions"), 1, MOST_POSITIONS))


def _shard(c: str, shards: int):
    return F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")


def _write(df: DataFrame, path: str, c: str, shards: int) -> None:
    """Range partitions split a term that most assets have; each writes to the few shards of its range.

    Rows are stored first, as ranges are found by a sample, which would make them twice.
    """
    df = storage.materialize(df, "lists")
    order = ["shard", *[x for x in df.columns if x == c], *[x for x in df.columns if x != c and not x.startswith("positions")]]
    df.withColumn("shard", _shard(c, shards)).repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    folder: str
    shards: int = SHARDS

    def _read(self, table: str, c: str, wanted: list[str]) -> DataFrame:
        """The postings of some keys; shards are numbers in the plan, so others are not listed."""
        if not wanted:
            return self.spark.read.parquet(f"{self.folder}/{table}").where("false")
        at = self.spark.createDataFrame([(x,) for x in wanted], "k string").select(_shard("k", self.shards).alias("s")).distinct().collect()
        return self.spark.read.parquet(f"{self.folder}/{table}").where(F.col("shard").isin([r.s for r in at]) & F.col(c).isin(wanted))

    def text_ranks(self, q: str) -> DataFrame:
        """asset_id, text_rank of the assets that hold a term of the query."""
        wanted = lexemes(self.spark, q)
        hits = self._read("terms", "term", wanted).groupBy("asset_id").agg(F.collect_list(F.struct("term", "positions")).alias("found"))  # as many as the query has terms
        return hits.select("asset_id", rank("found", len(wanted)).alias("text_rank"))

    def similar_values(self, q: str) -> DataFrame:
        """field, value whose trigram similarity to the query reaches ``SIMILAR``.

        A value shares at least ``SIMILAR`` of the query's trigrams, and its own number lies within a factor of that: both are tested on the
        counts of the merged lists, before any value is looked at.
        """
        wanted = sorted(_trigrams(q))
        m = len(wanted)
        lists = self._read("values", "gram", wanted).where((F.col("n") * SIMILAR <= m) & (F.col("n") >= SIMILAR * m))
        shared = lists.groupBy("field", "value", "n").agg(F.count("*").alias("hits")).where(F.col("hits") >= SIMILAR * m)
        return shared.where(F.col("hits") / (F.col("n") + m - F.col("hits")) >= SIMILAR).select("field", "value")

    def similar_fields(self, q: str) -> DataFrame:
        """asset_id and, per field, 1 where its value is similar to the query; only assets with one."""
        hits = self.spark.read.parquet(f"{self.folder}/assigned").join(self.similar_values(q), ["field", "value"])
        return hits.groupBy("asset_id").agg(*[F.max((F.col("field") == f).cast("int")).alias(f"near_{f}") for f in FIELDS])

    def names_with(self, q: str) -> DataFrame:
        """asset_id of the assets whose file name contains the query in any case."""
        low = q.lower()
        wanted = sorted(_inner_trigrams(low))
        if not wanted:  # too short for the index: all names
            return self.spark.read.parquet(f"{self.folder}/names").where(F.contains("file_name", F.lit(low))).select("asset_id").distinct()
        lists = self._read("names", "gram", wanted)
        return lists.groupBy("asset_id", "file_name").agg(F.count("*").alias("hits")).where((F.col("hits") == len(wanted)) & F.contains("file_name", F.lit(low))).select("asset_id")


def build(index: DataFrame, assets: DataFrame, folder: str, shards: int = SHARDS) -> SearchIndex:
    """Write the tables. ``index``: asset_id, indexing_status, searchable_text and the fields; ``assets``: asset_id, file_name."""
    index.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    live = index.where("indexing_status = 'INDEXED'")
    _write(postings(live), f"{folder}/terms", "term", shards)
    flat = live.select("asset_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select("asset_id", "x.field", "x.value").where("value is not null")
    flat.write.parquet(f"{folder}/assigned")
    grams = flat.select("field", "value").distinct().withColumn("grams", text.trigrams("value"))
    _write(grams.select("field", "value", F.size("grams").alias("n"), F.explode("grams").alias("gram")), f"{folder}/values", "gram", shards)
    names = assets.where("file_name is not null").select("asset_id", F.lower("file_name").alias("file_name")).distinct()
    # a name without any trigram still needs a row, for queries that are too short for the lists
    _write(names.select("asset_id", "file_name", F.explode_outer(text.trigrams("file_name")).alias("gram")), f"{folder}/names", "gram", shards)
    return SearchIndex(index.sparkSession, folder, shards)


def lexemes(spark: SparkSession, q: str | None) -> list[str]:
    """Distinct stems of a query's words, without stop words."""
    words = sorted({w for w in re.split(r"[\W_]+", (q or "").lower()) if w} - set(english.STOP_WORDS))
    return sorted({r.term for r in english.stemmed(spark.createDataFrame([(w,) for w in words], "word string")).collect()}) if words else []


def rank(found: str, wanted: int):
    """Rank of a text by its (term, positions) of the query, between 0 and 1.

    One term: its weight times the sum of 1/i**2 over its places, over the limit of that sum. More: every pair of places of two
    terms is evidence that grows with their nearness, and 1 minus the rank is the product of what each leaves open. Terms that
    aren't there add nothing, so a text needs two of them.
    """
    if wanted < 2:
        return F.expr(f"aggregate(sequence(1, size({found}[0].positions)), 0D, (s, i) -> s + 1D / (i * i)) * {WEIGHT}D / {LIMIT}D")
    near = f"{WEIGHT}D * sqrt(1D / (1.005D + 0.05D * exp(abs(u - v) / 1.5D - 2D)))"
    pair = f"aggregate(x.positions, r, (p, u) -> aggregate(y.positions, p, (o, v) -> o * CASE WHEN u <> v AND abs(u - v) <= {FAR} THEN 1D - {near} ELSE 1D END))"
    open_ = f"aggregate(sequence(1, size({found})), 1D, (q, i) -> aggregate(slice({found}, 1, i - 1), q, (r, y) -> {pair.replace('x.positions', f'{found}[i - 1].positions')}))"
    return F.expr(f"1D - {open_}")


def _words(s: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", s.lower()) if w]


def _trigrams(s: str) -> set[str]:
    return {p[i : i + 3] for w in _words(s) for p in (f"  {w} ",) for i in range(len(p) - 2)}


def _inner_trigrams(s: str) -> set[str]:
    """Trigrams that any name which contains ``s`` must have: words at the ends of ``s`` may go on there."""
    parts = re.split(r"[\W_]+", s)
    out = set()
    for i, w in enumerate(parts):
        p = ("  " if i else "") + w + (" " if i < len(parts) - 1 else "")
        out |= {p[j : j + 3] for j in range(len(p) - 2) if w}
    return out


def rank_sql(texts: str, q: str, name: str) -> str:
    """DuckDB: common table expressions, the last called ``name`` with asset_id and text_rank, over ``texts`` (asset_id, searchable_text)."""
    quoted, stop = q.replace("'", "''"), ", ".join(f"'{w}'" for w in english.STOP_WORDS)
    split = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    near = f"{WEIGHT} * sqrt(1 / (1.005 + 0.05 * exp(abs(x.p - y.p) / 1.5 - 2)))"
    return f"""
{name}_places AS (SELECT asset_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM (SELECT asset_id, {split.format("coalesce(searchable_text, '')")} AS w FROM {texts})),
{name}_asked AS (SELECT DISTINCT unnest({split.format(f"'{quoted}'")}) AS word),
{name}_words AS (SELECT word FROM (SELECT DISTINCT word FROM {name}_places UNION SELECT word FROM {name}_asked) WHERE word NOT IN ({stop})),
{english.stem_sql(f"{name}_words", f"{name}_stems")},
{name}_wanted AS (SELECT DISTINCT term FROM {name}_asked JOIN {name}_stems USING (word)),
{name}_found AS (SELECT asset_id, term, least(p, {LAST_POSITION}) AS p FROM {name}_places JOIN {name}_stems USING (word) WHERE term IN (SELECT term FROM {name}_wanted) GROUP BY ALL),
{name}_kept AS (SELECT *, row_number() OVER (PARTITION BY asset_id, term ORDER BY p) AS i FROM {name}_found QUALIFY i <= {MOST_POSITIONS}),
{name}_one AS (SELECT asset_id, sum(1 / (i * i)) * {WEIGHT} / {LIMIT} AS r FROM {name}_kept GROUP BY asset_id),
{name}_more AS (SELECT x.asset_id, 1 - exp(sum(ln(1 - {near}))) AS r FROM {name}_kept x JOIN {name}_kept y ON x.asset_id = y.asset_id AND x.term < y.term AND x.p <> y.p AND abs(x.p - y.p) <= {FAR} GROUP BY x.asset_id),
{name} AS (SELECT asset_id, CASE WHEN (SELECT count(*) FROM {name}_wanted) < 2 THEN o.r ELSE coalesce(m.r, 0) END AS text_rank FROM {name}_one o LEFT JOIN {name}_more m USING (asset_id))
"""
