"""Every query with SQL, against DuckDB on the smallest tables; the others against plain Python."""

import decimal
import os
import uuid

import duckdb
import pytest

from catalux.plans import audits, catalogue, library, records, runs  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    r = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)


def test_idempotency_keys(spark):
    files = {r.file_id: r.checksum for r in catalogue.fx.files(spark, SF, "file_id", "checksum").collect()}
    for r in catalogue.idempotency_keys(spark, SF).collect():
        assert r.key == str(uuid.uuid5(uuid.NAMESPACE_URL, f"asset-destination:{files[r.file_id]}|folder|v1"))


def test_token_costs_of_every_event(spark):
    events = catalogue.fx.table(spark, SF, "events").select("event_id", "user_id").collect()
    got = sorted((int(r.event_id), r.cost) for r in catalogue.token_costs(spark, SF).collect())
    micro = lambda e: (decimal.Decimal(e.event_id) * decimal.Decimal("2.5") + e.user_id * 10) / 1_000_000
    assert got == sorted((e.event_id, micro(e).quantize(decimal.Decimal("0.000001"), decimal.ROUND_HALF_UP)) for e in events)


def test_search_benchmark_ranks_every_document(spark, tmp_path):
    docs = [(i, "alpha beta" if i in (7, 11) else "alpha" if i in (13, 200) else "gamma" if i == 300 else "other") for i in range(7, 320)]
    items = [(1, "alpha beta"), (2, "gamma"), (3, "nowhere"), (4, None), (5, "beta")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for item, text in items:
        order = sorted((-len(set(t.split()) & set((text or "").split())), i) for i, t in docs)
        first = next(n for n, (_, i) in enumerate(order, 1) if i % 100 == 0)
        want.add((item, first, first <= 3))
    assert {tuple(r) for r in catalogue.search_benchmark(spark, str(tmp_path)).collect()} == want
