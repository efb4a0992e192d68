"""MinHash near-dedup and components against brute force."""

import random
import re

import pytest

from catalux.llm import minhash
from catalux.llm.components import connected_components


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 3), (4, 5), (7, 7)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(29, 50), (60, 50)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in connected_components(df).collect()} == want


def brute(rows, size, percent):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    s = [shingle(t) for _, t in rows]
    edges = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if s[i] and s[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    comp = union_find(edges)
    return sorted(((i, len(x), comp.get(i, i), i is None or comp.get(i, i) == i) for (i, _), x in zip(rows, s)), key=str)


@pytest.mark.parametrize("block", [512, 5])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(5)
    vocab = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = [r.choice(vocab) for _ in range(r.choice([5, 60, 150]))]
        for k in range(14):
            t = list(text)
            for _ in range(r.randrange(0, 5)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((r.randrange(10**6), " ".join(t)))
    rows += [(10**7, ""), (10**7 + 1, None), (10**7 + 2, "a b"), (10**7 + 3, "A  b"), (10**7 + 4, "a"), (None, rows[0][1]), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(df, size=3, percent=85, bands=20)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 85)


def test_blocks_grow_with_the_smaller_side_of_a_bucket(spark, monkeypatch):
    """Documents of a bucket's largest component meet the others in blocks, not each other; every other pair meets."""
    monkeypatch.setattr(minhash, "BLOCK", 10)
    rows = [(1, d, 7, 10, 0 if d < 200 else d) for d in range(208)] + [(2, d, 7, 10, d) for d in range(8)] + [(3, d, 7, 10, 5) for d in range(9)]
    labelled = spark.createDataFrame(rows, "key long, doc_id long, f1 long, n_bytes long, label long")
    mixed = minhash.mixed_buckets(labelled)
    assert {(r.key, r.n_top, r.n_rest) for r in mixed.collect()} == {(1, 20, 1), (2, 1, 0)}
    member = labelled.join(mixed, "key").withColumns({c: labelled.doc_id for c in ("sig", "keys", "packed")})
    got = minhash.in_blocks(member).collect()
    assert len(got) == 200 + 8 * 21 + 8  # in blocks of all documents, 21 for each of 208
    groups = {}
    for r in got:
        groups.setdefault((r.key, r.i, r.j), []).append(r)
    met = {(k, *sorted((x.doc_id, y.doc_id))) for (k, i, j), g in groups.items() for x in g for y in g if (x.block, y.block) == (i, j) and x.doc_id != y.doc_id}
    assert met >= {(k, x, y) for k, x, _, _, a in rows for l, y, _, _, b in rows if k == l and x < y and a != b}


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string, key long, u long")).count() == 0
