import random

from catalux.operators import termhits


def test_first_expected_against_brute_force(spark, monkeypatch):
    """Several blocks and steps; no row for a text and query leaves a task."""
    monkeypatch.setattr(termhits, "BLOCK", 3)
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [(i, r.sample(vocabulary, r.randrange(8)), i % 7 == 3) for i in range(-20, 300)] + [(400, None, True)]
    queries = [(i, r.sample(vocabulary + ["x", "y"], r.randrange(6))) for i in range(7)] + [(8, []), (9, ["x"]), (None, ["w1"])]
    df = spark.createDataFrame(texts + [(None, ["w1", "w2"], None)], "asset_id long, terms array<string>, expected boolean").repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, terms array<string>")
    got = termhits.first_expected(asked, df.where("asset_id is not null"))
    want = set()
    for item, terms in queries:
        order = sorted((-len(set(t or ()) & set(terms)), i, e) for i, t, e in texts)
        want.add((item, next(n for n, x in enumerate(order, 1) if x[2])))
    assert {tuple(x) for x in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {x.first_expected for x in termhits.first_expected(asked, df.where("not expected")).collect()} == {None}
    assert termhits.first_expected(asked.limit(0), df).count() == 0


def test_search_benchmark_gives_no_row_for_a_text_and_query(spark):
    from catalux.plans import catalogue

    plan = catalogue.search_benchmark(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # terms of texts were exploded and counted by (item_id, asset_id)
