"""Postings, ranks and trigram lists against brute force written from the definitions."""

import math
import re

import pytest

from catalux.functions import english
from catalux.operators import fulltext

TEXTS = [
    (1, "Hair transplants after a hair transplant: the hair, hair and HAIR."), (2, "A transplant of hair"), (3, "transplantation only"), (4, "hair " + "x " * 99 + "transplant"),
    (5, "hair " + "x " * 100 + "transplant"), (6, None), (7, ""), (8, "the of and"), (9, "hair " * 700), (10, "pad " * 16500 + "hair and transplants"), (11, "Hair-transplanting éclairs 3d"),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    fields = [("Long Hair Transplant", None, "Dr Hair"), ("hair", "Hair transplants", None), (None, "transplant", "Transplant, Hair")]
    rows = [(i, "INDEXED", t, *fields[i % 3]) for i, t in TEXTS] + [(12, "PENDING", "hair transplant", "Hair Transplant", None, None)]
    index = spark.createDataFrame(rows, "asset_id long, indexing_status string, searchable_text string, treatment string, subject string, doctor_name string")
    assets = spark.createDataFrame([(1, "My-Hair Transplant.JPG"), (2, "xhair transplants.png"), (3, "hair_transplant.png"), (4, "ha.mov"), (5, None), (6, "..."), (7, "chair transplant")], "asset_id long, file_name string")
    return fulltext.build(index, assets, f"{folder}/i", shards=5), rows, assets.collect()


def plain_rank(stems, document, q):
    split = lambda s: [w for w in re.split(r"[\W_]+", (s or "").lower()) if w]
    wanted = sorted({stems[w] for w in split(q) if w not in english.STOP_WORDS})
    at = {t: [] for t in wanted}
    for p, w in enumerate(split(document), 1):
        if w not in english.STOP_WORDS and stems[w] in at and min(p, 16383) not in at[stems[w]]:
            at[stems[w]].append(min(p, 16383))
    at = {t: p[:256] for t, p in at.items()}
    if len(wanted) == 1:
        return 0.1 * sum(1 / (i + 1) ** 2 for i in range(len(at[wanted[0]]))) / 1.64493406685
    left = 1.0
    for i, a in enumerate(wanted):
        for b in wanted[:i]:
            for u in at[a]:
                for v in at[b]:
                    if 0 < abs(u - v) <= 100:
                        left *= 1 - math.sqrt(0.1 * 0.1 / (1.005 + 0.05 * math.exp(abs(u - v) / 1.5 - 2)))
    return 1 - left


@pytest.mark.parametrize("q", ["hair", "Hair Transplants", "the transplanted hairs of", "nothing", "the", "hair transplant 3D eclair", "éclair hair"])
def test_ranks(spark, built, q):
    index, rows, _ = built
    words = sorted({w for t in [q, *(r[2] for r in rows)] for w in re.split(r"[\W_]+", (t or "").lower()) if w})
    stems = {r.word: r.term for r in english.stemmed(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    got = {r.asset_id: r.text_rank for r in index.text_ranks(q).collect()}
    assert set(got) <= {i for i, _ in TEXTS}, "what isn't indexed has no postings"
    if q != "the":
        for i, t in TEXTS:
            assert got.get(i, 0.0) == pytest.approx(plain_rank(stems, t, q), abs=1e-9), i
    else:
        assert got == {}


def similarity(a, b):
    grams = lambda s: {p[i : i + 3] for w in re.split(r"[\W_]+", (s or "").lower()) if w for p in [f"  {w} "] for i in range(len(p) - 2)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0


@pytest.mark.parametrize("q", ["hair transplant", "Dr", "transplant", "zzz"])
def test_similar_fields(built, q):
    index, rows, _ = built
    got = {r.asset_id: (r.near_treatment, r.near_subject, r.near_doctor_name) for r in index.similar_fields(q).collect()}
    for i, status, _, *fields in rows:
        want = tuple(int(status == "INDEXED" and f is not None and similarity(f, q) >= 0.3) for f in fields)
        assert got.get(i, (0, 0, 0)) == want


@pytest.mark.parametrize("q", ["hair transplant", "HAIR", "r t", "a", ".", "air transplant", "-h", "zzzz", "."])
def test_names(built, q):
    index, _, assets = built
    assert sorted(r.asset_id for r in index.names_with(q).collect()) == sorted(a.asset_id for a in assets if a.file_name and q.lower() in a.file_name.lower())


def test_a_query_reads_its_own_shards_only(spark, built):
    index, _, _ = built
    plan = index.text_ranks("hair")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "searchable_text" not in plan
    files = {f.split("shard=")[1].split("/")[0] for f in index._read("terms", "term", ["hair"]).inputFiles()}
    every = {f.split("shard=")[1].split("/")[0] for f in spark.read.parquet(f"{index.folder}/terms").inputFiles()}
    assert len(every) > 1 and len(files) <= len(every)
    read = index._read("terms", "term", ["hair"]).select("shard").distinct().count()
    assert read == 1


def test_no_place_of_a_word_is_shuffled(spark):
    """Texts of distinct keys are postings where they are read; those of repeated keys are put together."""
    df = spark.createDataFrame(TEXTS, "asset_id long, searchable_text string").coalesce(1)
    found = fulltext.postings(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.asset_id, r.term): r.positions for r in found.collect()}
    assert len(got) == found.count() and got[1, "hair"] == [1, 5, 8, 9, 11] and got[9, "hair"] == list(range(1, 257)) and got[10, "hair"] == [16383] and got[10, "pad"] == list(range(1, 257))
    assert not {a for a, _ in got} & {6, 7, 8} and got[11, "éclair"] == [3] and got[11, "3d"] == [4]
    twice = {(r.asset_id, r.term): r.positions for r in fulltext.postings(df.union(spark.createDataFrame([(2, "hair b hair"), (9, "pad hair")], df.schema))).collect()}
    assert twice == {**got, (2, "hair"): [1, 3, 4], (2, "b"): [2], (9, "pad"): [1]}
