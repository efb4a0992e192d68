"""Many queries at once against the single search of each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalux.operators import batchrank, fulltext, search


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    r = random.Random(6)
    words = ["hair", "hairs", "transplant", "transplants", "clinic", "doctor", "talks", "the", "of", "result", "results", "before", "after", "scalp"]
    rows = [(i, r.choice(["INDEXED"] * 5 + ["PENDING"]), " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 30, 200]))), r.choice([None, "Hair Transplant", "Scalp therapy"]), r.choice([None, "Doctor talks"]), r.choice([None, "Dr Hair", "Dr Scalp"])) for i in range(240)]
    rows += [(500 + i, "INDEXED", "same text of hair results", "Hair Transplant", None, None) for i in range(5)]
    index = spark.createDataFrame(rows, "asset_id long, indexing_status string, searchable_text string, treatment string, subject string, doctor_name string")
    assets = spark.createDataFrame([(x[0], f"{r.choice(['Hair', 'clinic', 'f'])}{x[0]}.mov", "video/mp4", "mp4") for x in rows], "asset_id long, file_name string, mime_type string, file_extension string").repartition(7)
    return index, assets, fulltext.build(index, assets, f"{tmp_path_factory.mktemp('lib')}/i", shards=4)


def test_equals_single_searches(spark, library, monkeypatch):
    index, assets, terms = library
    monkeypatch.setattr(batchrank, "BLOCK", 3)
    monkeypatch.setattr(batchrank, "ROWS", 16)
    asked = ["hair transplant", "Hair", "the of", "doctor talks results of a clinic", "f1", "zzz", "scalp therapy", "  "]
    queries = spark.createDataFrame(list(enumerate(asked)) + [(99, None)], "query_id long, q string")
    got = {}
    for r in batchrank.top_assets(queries, assets, terms, k=4).collect():
        got.setdefault(r.query_id, []).append((r.place, r.asset_id, round(r.raw, 8)))
    every = assets.join(index.withColumn("indexing_status", F.lit("INDEXED")).select("asset_id", "indexing_status"), "asset_id", "left_semi")
    for i, q in enumerate(asked):
        df = search._found(every, terms, q.strip() or None)
        raw = F.round(0.20 * F.col("c_text") + 0.08 * F.col("near_treatment") + 0.07 * F.col("near_subject") + 0.10 * F.col("near_doctor_name") + 0.10 * F.col("named"), 9)
        want = [(n, r.asset_id, round(r.raw, 8)) for n, r in enumerate(df.select("asset_id", raw.alias("raw")).orderBy(F.desc("raw"), "asset_id").limit(4).collect(), 1)]
        assert sorted(got[i]) == want, q
    assert [x[1] for x in sorted(got[99])] == [0, 1, 2, 3]


def test_the_bound_holds(spark, library):
    """No rank is above what the numbers of places allow."""
    index, assets, terms = library
    block = next(batchrank.blocks(terms, spark.createDataFrame([(1, "before after results")], "query_id long, q string")))
    rows = batchrank._candidates(assets, terms, block).coalesce(1).collect()
    found = [r for r in rows if r.found]
    for r in found:
        p = np.concatenate([x.positions for x in r.found]).astype(np.int64)
        t = np.concatenate([[x.no] * len(x.positions) for x in r.found])
        exact = batchrank.pair_rank(p, t)
        n = np.array([len(x.positions) for x in r.found])
        bound = 1 - (1 - batchrank.NEAR[1]) ** ((n.sum() ** 2 - (n * n).sum()) / 2)
        assert exact <= bound + 1e-12
    assert len(found) < len(rows)


def test_benchmark_counts(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "query_id long, type string")
    top = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12), (3, 3, 13)], "query_id long, place int, asset_id long")
    expected = spark.createDataFrame([(1, 11), (1, 10), (2, 99), (3, 13)], "query_id long, asset_id long")
    got = batchrank.benchmark(q, top, expected)
    assert sorted((r.query_id, r.expected_rank, r.passed) for r in got.collect()) == [(1, 1, True), (2, None, False), (3, 3, True), (4, None, None)]
    assert sorted(tuple(r) for r in batchrank.by_type(got).collect()) == [("a", 1, 2), ("b", 1, 1)]


def test_no_queries(spark, library):
    _, assets, terms = library
    assert batchrank.top_assets(spark.createDataFrame([], "query_id long, q string"), assets, terms).count() == 0


def test_each_pair_of_places_is_met_once_for_all_queries(monkeypatch):
    """The sums are those of each text and query alone, in any cut of the texts; ranks that tie cost no more than others."""
    r = random.Random(3)
    asked = [[0, 1], [0, 1, 2, 5], [3], [], [1, 4, 5]] * 20
    bits = batchrank.query_bits(asked, 6)
    texts = [sorted({(r.randrange(1, 400), r.randrange(6)) for _ in range(r.choice([0, 1, 40, 200]))}) for _ in range(9)] + [[(16383, t) for t in range(6)]]
    doc, place, term = (np.array([x[i] for x in ((d, p, t) for d, text in enumerate(texts) for p, t in text)], np.int64) for i in range(3))
    mix = np.random.default_rng(1).permutation(len(doc))
    for places in (1 << 18, 30):
        monkeypatch.setattr(batchrank, "PLACES", places)
        got = -np.expm1(batchrank.pair_sums(doc[mix], term[mix], place[mix], bits, (10, 128)))
        for d in range(10):
            for i, a in enumerate(asked):
                mine = (doc == d) & np.isin(term, a)
                assert got[d, i] == pytest.approx(batchrank.pair_rank(place[mine], term[mine]) if len(a) > 1 else 0, abs=1e-12)
    assert not got[:, 100:].any()
