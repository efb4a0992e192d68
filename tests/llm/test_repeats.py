"""Suffix-array and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from catalux.llm import substring_dedup, suffix_dedup, windows
from catalux.llm import suffix_array as suffix_array_module
from catalux.llm.suffix_array import permuted_common_prefix, suffix_array


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, s = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        x = rng.integers(0, s, n).astype(np.uint8)
        order = sorted(range(n), key=lambda i: x[i:].tolist())
        sa = suffix_array(x)
        assert sa.tolist() == order
        p = permuted_common_prefix(x, sa)
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < n and x[a + k] == x[b + k]:
                k += 1
            assert p[b] == k


def test_induced_sorting_of_large_alphabets(monkeypatch):
    monkeypatch.setattr(suffix_array_module, "MOST_BUCKETS", 3)
    test_suffix_array_and_common_prefixes()


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["the", "of", "Ünd", "a", "thane", "ouvi", "nd", "er", "tion", "x" * 30]
    line = lambda k: " ".join(r.choice(vocab) + str(r.randrange(40)) * (r.random() < 0.4) for _ in range(k))
    shared = [line(k) for k in (12, 30, 80, 200)]
    rows = []
    for i in range(n):
        parts = [line(r.randrange(1, 60)) for _ in range(r.randrange(0, 5))]
        parts.insert(r.randrange(len(parts) + 1), r.choice(shared)[r.randrange(20) :])
        rows.append((r.randrange(10**6), " ".join(parts)))
    base = rows[3][1]
    rows += [(2_000_000 + i, base) for i in range(8)] + [(3_000_000 + i, base[:200] + str(i) + base[205:]) for i in range(8)]
    rows += [(None, base), (5, None), (7, ""), (8, "a"), (9, "ab" * 300), (10, "ab" * 200), rows[2], rows[2]]
    rows += [(9_000_000, line(40)), (9_000_000, shared[2] + line(30)), (1, shared[2]), (9_000_001, line(90) + base[:150]), (9_000_001, base[20:] + line(5))]  # several texts of an id
    return list({(i, t): 0 for i, t in rows}) + [rows[2]]


def brute_bytes(rows, length):
    first = {}
    for i, t in rows:
        if i is not None and t:
            b = t.encode()
            for j in range(len(b) - length + 1):
                first[b[j : j + length]] = min(i, first.get(b[j : j + length], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for j in range(len(b) - length + 1):
                if first[b[j : j + length]] < i:
                    gone[j : j + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append([0], gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,local", [(1 << 17, 256), (3, 10**6), (1, 2)])
def test_suffix_dedup(spark, monkeypatch, hot, local):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "LOCAL", local)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.dedup_bytes(df).collect()), key=str) == brute_bytes(rows, 50)


def test_suffix_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans string, h long")
    assert suffix_dedup.dedup_bytes(df).count() == 0


def brute_words(rows, length):
    first = {}
    split = {t: (t or "").encode().split() for _, t in rows}
    for i, t in rows:
        w = split[t]
        for j in range(len(w) - length + 1) if i is not None else ():
            first[tuple(w[j : j + length])] = min(i, first.get(tuple(w[j : j + length]), i))
    out = []
    for i, t in rows:
        w = split[t]
        gone = [False] * len(w)
        for j in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[j : j + length])] < i:
                gone[j : j + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,k", [(50, 20), (12, 4)])
def test_substring_dedup(spark, length, k):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring_dedup.dedup_words(df, length, k).collect()), key=str) == brute_words(rows, length)


def test_paths_decide(spark, monkeypatch):
    """Without the compaction nothing of a passage that doesn't branch is removed."""
    passage = " ".join(f"w{i}" for i in range(600))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.dedup_words(df).collect()), key=str) == brute_words(rows, 50)
    whole = substring_dedup.compact
    monkeypatch.setattr(substring_dedup, "compact", lambda node, length: whole(node, length).where("c is null"))
    assert {r.n_removed for r in substring_dedup.dedup_words(df).collect() if r.doc_id} != {600}


def test_substring_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, h long, c long")
    assert substring_dedup.dedup_words(df).count() == 0


def test_spans_of_a_text_are_one_row(spark, monkeypatch):
    """However many shards its runs go to."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 256)
    monkeypatch.setattr(suffix_dedup, "PART_RUNS", 1 << 8)
    r = random.Random(3)
    long = " ".join(str(r.randrange(10**6)) for _ in range(300))
    rows = [(1, long)] + [(i, f"{i} {long[i:]} {i}") for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = suffix_dedup.repeated_spans(df, windows.text_classes(df, "t"))
    assert sorted(x.doc_id for x in spans.collect()) == list(range(2, 30))
    assert sorted(map(tuple, suffix_dedup.dedup_bytes(df).collect()), key=str) == brute_bytes(rows, 50)


def shuffled_texts(df):
    """Exchanges of a plan that packed texts go through."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum("Exchange" in head and "packed" in head for head in plan.split("\n\n"))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_shuffled_once_a_step(spark, monkeypatch, no_broadcast):
    """Where no side is small enough to be broadcast: once for the lists, once for the spans."""
    df = spark.createDataFrame(corpus(3), "doc_id long, text string").repartition(3)
    texts, _ = windows.with_shared(df, windows.text_classes(df, "t"), "word", 50, 20, "t")
    assert shuffled_texts(texts) == 1
    packed, made = windows.packed_texts, []
    monkeypatch.setattr(substring_dedup, "packed_texts", lambda docs: made.append(1) or packed(docs))
    found = substring_dedup.dedup_words(df)
    assert len(made) == 1 and shuffled_texts(found) == 1
    assert sorted(map(tuple, found.collect()), key=str) == brute_words(corpus(3), 50)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    """Passages whose words have the same hashes at the same places: the digest of a super-edge is of the words."""
    plain = windows.symbols

    def alike(column, kind):
        s, offsets, (_, starts, ends) = plain(pa.array([x.replace(b"y", b"x") for x in column.to_pylist()], pa.binary()), kind)
        return s, offsets, (windows.utf8(column)[0], starts, ends)

    monkeypatch.setattr(substring_dedup, "symbols", alike)
    texts = [" ".join(f"w{i}{x}" for i in range(300)).encode() for x in "xy"]
    h = (windows.runs(*alike(pa.array(texts[:1], pa.binary()), "word")[:2], 50, 20)[3] & windows.MASK).view(np.int64).tolist()
    cols = {"doc_id": [1, 2], "k1": [1, 2], "packed": [zstandard.compress(x) for x in texts], "shared": pa.array([h, h], pa.list_(pa.int64())), "hot": pa.array([[], []], pa.list_(pa.int64()))}
    rows = [r for b in substring_dedup._occurrences(50, 20)(iter([pa.record_batch(cols)])) for r in b.to_pylist()]
    one, two = ([r for r in rows if r["doc_id"] == i] for i in (1, 2))
    assert [r["h"] for r in one] == [r["h"] for r in two] and len(one) > 1
    assert not {r["c"] for r in one} & {r["c"] for r in two}
