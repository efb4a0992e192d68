"""Spelling variants against a brute-force version written from the definition."""

import random
import re
import zlib
from collections import Counter

import pytest

from catalux.llm import spelling


def plain(rows, noise=31, least=7, count=2, ratio=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % noise == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, found = {}, {w: [] for w in n}
    names = sorted(n)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and near(a, b):
                found[a].append(b)
                found[b].append(a)
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return out


def corpus(seed, texts=60, stems=20):
    """Stems, and misspellings of all kinds at the ends and within, some with repeated letters; counts over some powers of ten."""
    r = random.Random(seed)
    letter = "aabcdeßéÿ×"
    words = ["".join(r.choice(letter) for _ in range(r.randrange(6, 13))) for _ in range(stems)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab"]
    spelled = []
    for w in words:
        spelled += [w] * r.choice([3, 40, 300])
        for _ in range(8):
            v = w
            for _ in range(r.choice([1, 1, 1, 2])):
                k = r.randrange(len(v) + 1)
                v = r.choice([v[:k] + r.choice(letter) + v[k:], v[: k - 1] + v[k:] if k else v[1:], v[:k] + r.choice(letter) + v[k + 1 :]])
            spelled += [v] * r.choice([1, 2, 2, 3, 25])
    spelled += ["chainword"] * 3000 + ["chainwore"] * 200 + ["chaimwore"] * 12
    r.shuffle(spelled)
    spelled = [w.upper() if r.random() < 0.1 and w.isascii() else w for w in spelled]
    each = len(spelled) // texts + 1
    return [(i, r.choice([" ", ", ", "1", "\n", "ж"]).join(spelled[i * each : (i + 1) * each])) for i in range(texts)]


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("depth, block", [(2, 1024), (2, 3), (1, 2), (3, 1024)])
def test_equals_brute_force(spark, depth, block):
    docs = corpus(depth * 10 + block % 7)
    got = rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), depth=depth, block=block))
    want = plain(docs)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(x[1] and x[2] != x[1] for x in want), "chains are in the test"


def test_edge_rows(spark):
    long = "z" * 70_000
    docs = [(1, None), (None, "spelling spelling spellings spellings"), (None, None), (2, ""), (2, "123 !"), (2, f"{long} {long} y{long}"), (2, f"y{long}"), (2, "SPELLING" + " spelling" * 60), (3, "speling speling")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long")
    assert set(rows(spelling.variants(df))) == plain(docs)
    assert rows(spelling.variants(df.limit(0))) == []


def test_count_filter_and_depth_bound():
    with pytest.raises(ValueError):
        spelling.variants(None, least=4)


def test_lists_that_are_too_long_go_deeper(spark):
    """One key for all words: everything must go down to a bounded depth, and no pair may be lost or repeated."""
    docs = [(i, " ".join(f"sameword{a}{b}" for a in "abcdefgh" for b in "klmnopqrst")) for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = spelling.vocabulary(df, noise=0)
    pairs = [(r.word, r.near) for r in spelling.near_pairs(words, depth=1, block=5).collect()]
    assert len(pairs) == len(set(pairs)) == 80 * (7 + 9)
