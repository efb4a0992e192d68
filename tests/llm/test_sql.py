"""The queries with SQL against DuckDB: on the smallest tables, and some on rows at the edge."""

import os

import duckdb
import pytest

from catalux.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compare(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        p = f"{folder}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    found = c.execute(registry.SQL[name])
    have = [x[0] for x in found.description]
    assert sorted(have) == names
    at = [have.index(x) for x in names]
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_smallest_tables(spark, name):
    compare(spark, SF, name)


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    long = " ".join(f"wörter{i * 7919 % 1009}" for i in range(400))
    rows = [
        (1, long), (2, long), (3, long.replace("wörter7 ", "")), (4, long.upper()),
        (5, None), (6, ""), (7, " \n\t "), (8, "two words"), (9, "Two  words"), (10, "two"),
        (None, long), (None, None), (11, "x" * 120), (12, "x" * 49), (13, "y" + "x" * 60 + "z"),
        (14, long), (14, None), (14, "another text of the same id, which repeats nothing that is anywhere else in this table"),
        (15, "é" * 60), (16, "a" + "é" * 40), (16, "a" + "é" * 40),
    ]
    duckdb.connect().execute(
        f"copy (select unnest(?::bigint[]) as doc_id, unnest(?::varchar[]) as text) to '{folder}/documents.parquet'",
        [[r[0] for r in rows], [r[1] for r in rows]],
    )
    duckdb.connect().execute(f"copy (select unnest(?::varchar[]) as text) to '{folder}/benchmark.parquet'", [[long, None, "two words"]])
    return folder


@pytest.mark.parametrize("name", ["op3_minhash", "op4_suffix_dedup", "op11_spelling", "op13_resampling"])
def test_edge_rows(spark, edge, name):
    compare(spark, edge, name)
