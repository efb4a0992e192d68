"""Quality counts and verdicts, and decontamination, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from catalux.llm import decontaminate, quality


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    g = Counter(zip(w, w[1:], w[2:]))
    rep = {i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)]


def test_counts():
    r = random.Random(1)
    texts = [None, "", "\n\n \n", "a\x1cb é|é"] + ["".join(r.choice(["a", "b ", "é\n", "\n", "\t", "## ", "c d ", "\x0b"]) for _ in range(r.randrange(80))) for _ in range(300)]
    got = np.stack(quality.counts(pa.array(texts, pa.string())), 1).tolist()
    assert got == [brute_counts(t) for t in texts]


def test_quality_verdict(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["ba", "te", "no", "ri"]) for _ in range(3))
    clean = [" ".join(word() for _ in range(120)) for _ in range(60)]
    junk = [" ".join(word() + "$%#"[i % 3] * 3 for i in range(120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(clean + junk)] + [(None, clean[0]), (500, None), (501, ""), (0, clean[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 90, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    # the ratio, by hand
    token = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\x00-\x200-9A-Za-z\x80-\U0010ffff]+", t or "")
    assert math.isfinite(model.threshold) and len(token("a$$$ b")) == 3
    got = {(x.doc_id, x.n_words): x for x in quality.judge(docs, model).collect()}
    assert sum(got[i, 120].kept for i in range(60)) >= 50 and not any(got[i, 120].kept for i in range(60, 90))
    assert got[500, 0].base_failed and not got[501, 0].kept
    raw = Counter()
    for _, t in rows:
        b, _ = quality.ngrams(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), quality.BUCKETS)
        raw.update(b.tolist())
    target = Counter()
    for i, t in rows:
        if i is not None and i < 60 and i % 4 == 0:
            target.update(quality.ngrams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), quality.BUCKETS)[0].tolist())
    x = max(target, key=target.get)
    share = (raw[x] + 1e-3) / (sum(raw.values()) + 1e-3 * quality.BUCKETS)
    assert model.ratio[x] == pytest.approx(math.log((target[x] + quality.PRIOR * share) / (sum(target.values()) + quality.PRIOR) / share))
    none = quality.fit(spark.createDataFrame([], "doc_id long, text string"), labels)
    assert none.threshold == -np.inf


def test_every_labelled_document_takes_part(spark):
    """Of 20,500 labelled ids none is left out, and every second one is held out."""
    labels = spark.range(20_500).selectExpr("id * 3 AS doc_id", "1 AS quality", "0 AS toxic")
    rows = sorted(map(tuple, quality.sides(labels.repartition(3)).collect()))
    assert rows == [(3 * i, i % 2 == 1) for i in range(20_500)]
    assert sorted(map(tuple, quality.sides(labels.limit(1)).collect())) == [(0, False), (0, True)]
    docs = spark.range(20_500).selectExpr("id * 3 AS doc_id", "concat('w', id) AS text")
    assert quality.fit(docs, labels).threshold > -np.inf


def test_texts_of_labelled_documents_are_not_shuffled(spark, monkeypatch):
    """Ids go to the texts, in blocks; the model is the same for any size of block and broadcast limit."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w', id % 50, ' v', id % 7) AS text")
    labels = spark.range(1000).selectExpr("id * 3 AS doc_id", "1 AS quality", "0 AS toxic")
    want = quality.fit(docs, labels)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans, plain = [], quality.labelled
    monkeypatch.setattr(quality, "labelled", lambda *a: (plans.append(x._jdf.queryExecution().toString()) or x for x in plain(*a)))
    monkeypatch.setattr(quality, "IDS", 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = quality.fit(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 8 and not any("SortMergeJoin" in p or "hashpartitioning" in p for p in plans)
    assert np.array_equal(got.ratio, want.ratio) and got.threshold == want.threshold


def test_nth_score(spark):
    r = random.Random(4)
    x = [r.gauss(0, 1) for _ in range(300)] + [0.25] * 50 + [9e5]
    df = spark.createDataFrame([(v,) for v in x], "score double").coalesce(1)
    assert [quality.nth(df, k, few=20) for k in (0, 170, 200, 350)] == [sorted(x)[k] for k in (0, 170, 200, 350)]


def brute_contamination(docs, items, window=10):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = {}
    for i, t in items:
        w = tok(t)
        n = min(len(w), window)
        for j in range(len(w) - n + 1) if w else ():
            grams.setdefault(tuple(w[j : j + n]), set()).update([] if i is None else [str(i)])
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w = tok(t)
        hit, ids = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (x := grams.get(tuple(w[j : j + n]))) is not None:
                    ids |= x
                    hit |= set(range(j, j + n))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination(spark):
    r = random.Random(3)
    words = ["the", "of", "Été", "x1", "nd", "er", "tion", "ein", "ver", "que"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 9, 10, 11, 30])))) for i in range(25)] + [(100, None), (101, "..."), (None, "the of"), (7, "the nd er")]
    docs = []
    for i in range(60):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 40)))]
        if i % 3 == 0:
            parts.append((r.choice(items)[1] or "").upper().replace(" ", ", "))
        docs.append((i, "\n".join(parts)))
    docs += [(60, None), (61, ""), (None, "the nd er"), (5, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=str) == brute_contamination(docs, items)
    empty = spark.createDataFrame([], "doc_id long, text string, docs int")
    assert decontaminate.contamination(empty, b).count() == 0
    assert not any(x.contaminated for x in decontaminate.contamination(d, b.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "delta gamma beta alpha"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    exact = {r.doc_id for r in decontaminate.search(index, items).collect() if r.matches}
    near = {r.doc_id for r in decontaminate.search(index, items, slop=1).collect() if r.matches}
    assert exact == {3} and near == {1, 3}


def test_several_blocks_of_items(spark, monkeypatch):
    r = random.Random(5)
    words = ["the", "of", "Été", "x1", "nd", "er"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([2, 3, 12])))) for i in range(40)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(40)] + [(None, items[0][1]), (3, items[1][1]), (3, items[1][1]), (50, None)]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", sum(len(t.encode()) for _, t in items) // 3)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate.item_blocks(b))) > 2
    assert sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=str) == brute_contamination(docs, items)


def test_windows_are_looked_up_together(monkeypatch):
    """Matches are those of brute force, in any cut of the windows; the steps don't grow with the windows."""
    r = random.Random(9)
    pick = lambda n: " ".join(r.choice("abcdefg") for _ in range(n))
    texts = [pick(r.choice([0, 1, 5, 60, 300])) for _ in range(30)]
    asked = [(str(i), pick(r.choice([1, 2, 3, 4, 5, 9]))) for i in range(200)] + [("n", None), ("z", "zz a")]
    (segment,) = decontaminate._build(iter([pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], ["doc_id", "text"])]))
    known = decontaminate.Items(asked, 4)
    n = np.asarray(segment.column("n_words").values, np.int64)
    all_words = " ".join(texts).split()
    doc_of = np.repeat(np.arange(len(n)), n)
    z = decontaminate.zstandard.ZstdDecompressor()
    parts = [z.decompress(segment.column(c)[0].as_py()) for c in ("terms", "postings")]
    calls, plain = [], np.searchsorted
    for starts, slop in ((1 << 19, 0), (50, 0), (1 << 19, 1), (50, 1)):
        monkeypatch.setattr(decontaminate, "STARTS", starts)
        monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or plain(*a, **k))
        calls.clear()
        w, p = decontaminate.match(known, *parts, doc_of, slop)
        monkeypatch.setattr(np, "searchsorted", plain)
        assert starts < 100 or len(calls) < 10 < len(known.item) / 10
        want = set()
        for k in range(len(known.item)):
            terms = [known.text[t].decode() for t in known.term[k][: known.length[k]]]
            for s in range(len(all_words) - len(terms) + 1):
                near = lambda j, s=s, terms=terms: terms[j] in all_words[max(0, s + j - slop) : s + j + slop + 1]
                if doc_of[s] == doc_of[s + len(terms) - 1] and all(map(near, range(len(terms)))):
                    want.add((k, s))
        got = set(zip(w.tolist(), p.tolist(), strict=True))
        assert len(got) == len(w) and (got == want if not slop else got <= want and len(got) > 0)


def test_blocks_of_items_go_by_their_bytes(spark, monkeypatch):
    """Many small files are one block; small blocks hold every item once and find the same."""
    items = spark.range(60).selectExpr("CAST(id AS STRING) AS item_id", "concat('w', id, ' x y z') AS text")
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a w', id * 2, ' x y z b') AS text")
    plain = type(items).repartition
    monkeypatch.setattr(type(items), "repartition", lambda df, n, *c: plain(df, max(n, 13), *c))
    (block,) = decontaminate.item_blocks(items)
    assert len(block) > 5 and sorted(map(int, decontaminate._load(block, 10).ids)) == list(range(60))
    want = sorted(map(tuple, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 200)
    blocks = decontaminate.item_blocks(items)
    assert len(blocks) > 2 and sorted(int(i) for b in blocks for i in decontaminate._load(b, 10).ids) == list(range(60))
    assert sorted(map(tuple, decontaminate.contamination(docs, items).collect())) == want and sum(r[5] for r in want) == 30
