"""Importance resampling against a brute-force version written from the definition."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from catalux.llm import checksum, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, target, percent=5, least=20):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n])
    fit = sorted((x for x in out if x[5] >= least and x[3] is not None), key=lambda x: (-x[3], x[0], x[1], x[2]))
    for k, x in enumerate(fit[: len(fit) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    names = [f"wört{i}" for i in range(40)] + ["Ab", "x1", "ж", "aB9"]
    return [(i, r.choice([" ", "_", "\n"]).join(r.choice(names) for _ in range(r.choice([0, 1, 2, 5, 19, 20, 21, 90])))) for i in range(n)]


def test_equals_brute_force(spark):
    docs = corpus(1, 400)
    docs += [(None, "null id " * 30), (None, None), (7, docs[7][1]), (7, "another text of this id " * 9), (401, None), (402, ""), (403, "... !"), (404, "long text " * 40_000)]
    docs += [(405, docs[9][1])] * 5
    target = [x for _, x in corpus(2, 30)] + [None, ""]
    frame = spark.createDataFrame([(i, x, "a", 1) for i, x in docs], "doc_id long, text string, rank string, weight long").repartition(5)
    have = got(resampling.resampled(frame, spark.createDataFrame([(x,) for x in target], "text string"), percent=20))
    assert have == plain(docs, target, percent=20)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = corpus(3, 60)
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(resampling.resampled(none, some)) == []
    assert got(resampling.resampled(some, none)) == plain(docs, [])


def test_stream_is_packed_with_offsets():
    texts = ["", "one", "one Two", "a b c d", "", "x" * 100 + " y"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    n, stream, at = resampling.packed(raw, np.append(0, np.cumsum([len(x) for x in texts])))
    assert stream.dtype == np.uint16 and n.tolist() == [0, 1, 2, 4, 0, 2]
    for i, x in enumerate(texts):
        assert sorted(stream[at[i] : at[i + 1]].tolist()) == sorted(features(x)[1])


def test_blocks_of_words_join(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(500))
    raw = np.frombuffer(text.encode(), np.uint8)
    want = sorted(features(text)[1])
    for block in (1, 2, 3, 7, 499, 500):
        monkeypatch.setattr(resampling, "BLOCK", block)
        assert sorted(resampling.packed(raw, np.array([0, len(raw)]))[1].tolist()) == want


def test_checksums():
    r = random.Random(5)
    raw = np.frombuffer(r.randbytes(90_000), np.uint8)
    start = np.array([r.randrange(10_000) for _ in range(400)])
    size = np.array([r.choice([0, 1, 2, 63, 64, 65, 128, 4097, 70_000]) for _ in start])
    one = checksum.crc32(raw, start, start + size)
    assert one.tolist() == [zlib.crc32(raw[a : a + n]) for a, n in zip(start, size, strict=True)]
    both = checksum.joined(one[:-1], one[1:], size[1:])
    assert both.tolist() == [zlib.crc32(raw[b : b + m], zlib.crc32(raw[a : a + n])) for a, n, b, m in zip(start[:-1], size[:-1], start[1:], size[1:], strict=True)]
