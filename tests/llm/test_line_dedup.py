"""Line dedup against brute force."""

import decimal
import random

import pytest
from pyspark.sql import functions as F

from catalux.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_within(spark, k):
    r = random.Random(k)
    rows = []
    for _ in range(400):
        a = [r.choice(b"abc") for _ in range(r.randrange(4, 14))]
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.choice(b"abc")] * r.randrange(2)
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if len(b) > k and len(a) - len(b) <= k:
            rows.append((bytearray(a), bytearray(b), distance(a, b) <= k))
    df = spark.createDataFrame(rows, "a binary, b binary, want boolean")
    bad = df.withColumn("got", line_dedup.within(F.col("a"), F.col("b"), k)).where("got <> want").collect()
    assert not bad, bad[:3]
    pairs = df.withColumnsRenamed({"a": "long", "b": "short"})
    assert sorted(map(tuple, line_dedup.near_lines(pairs, k).collect())) == sorted(tuple(r) for r in rows if r[2])


def test_sketches_of_near_lines_are_alike(spark):
    """k edits change 2 * k bits at most, and most unrelated lines differ in more than eight."""
    r = random.Random(11)
    rows = []
    for _ in range(600):
        a = r.choices("eeeaaatttnnniioorsl  é", k=r.randrange(32, 90))
        b, k = list(a), r.randrange(5)
        for _ in range(k):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = r.choices("eatnx ", k=r.randrange(2))
        rows.append(("".join(a), "".join(b), distance("".join(a).encode(), "".join(b).encode())))
    bits = F.bit_count(line_dedup.sketch(F.col("a")).bitwiseXOR(line_dedup.sketch(F.col("b"))))
    got = spark.createDataFrame(rows, "a string, b string, d int").select("d", bits.alias("n")).collect()
    assert all(x.n <= 2 * x.d for x in got) and any(x.n == 2 * x.d > 0 for x in got)
    far = spark.createDataFrame([(x[0], y[0]) for x, y in zip(rows, rows[1:])], "a string, b string").select(bits.alias("n")).collect()
    assert sum(x.n > 8 for x in far) > 0.9 * len(far)


def test_far_lines_of_one_key_are_not_compared(spark, monkeypatch):
    """Of lines that share a segment the distance sees those with like counts of letters only."""
    monkeypatch.setattr(line_dedup, "_near", lambda long, short, threshold: F.raise_error(F.lit("compared")).cast("boolean"))
    head = "the same ten bytes "
    texts = [head + "".join(3 * x for x in letters) for letters in ("eanirtsodl", "ucmpghvyqk", "eariscugvq", "ntodlmphyk")]
    lines = spark.createDataFrame([(i, i, t, decimal.Decimal(i)) for i, t in enumerate(texts)], "id long, b long, line string, first decimal(32,0)")
    assert line_dedup.near_earlier(lines, 4, 32).count() == 0


def test_rounds_hold_every_segment_once():
    assert [[*r] for r in line_dedup.rounds(4)] == [[1, 2], [3], [4], [5]]
    assert all([i for r in line_dedup.rounds(k) for i in r] == [*range(1, k + 2)] for k in range(6))


def brute(rows, k, least):
    lines = sorted({(i, n, x) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n")) if len(x.encode()) >= least})
    first = {}
    for i, n, x in lines:
        first.setdefault(x, (i, n))
    near = {x for x in first for y in first if first[y] < first[x] and abs(len(x.encode()) - len(y.encode())) <= k and distance(x.encode(), y.encode()) <= k}
    gone, close = {}, {}
    for i, n, x in lines:
        if x in near or (i, n) > first[x]:
            gone.setdefault(i, set()).add(n)
        if x in near:
            close.setdefault(i, set()).add(n)
    out = []
    for i, t in rows:
        p = (t or "").split("\n")
        g = {n for n in gone.get(i, ()) if n < len(p)}
        kept = "\n".join(x for n, x in enumerate(p) if n not in g)
        out.append((i, len(p), len(g), len(close.get(i, ())), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 2])
def test_dedup_lines(spark, k):
    r = random.Random(9)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(6, 30))) for _ in range(25)]
    rows = []
    for i in range(50):
        out = []
        for _ in range(r.randrange(0, 6)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                x[r.randrange(len(x))] = r.choice(["", "z", "éé"])
            out.append("".join(x))
        rows.append((r.randrange(10**4), "\n".join(out)))
    rows = list({i: (i, t) for i, t in rows}.values()) + [(None, base[0]), (10**5, None), (10**5 + 1, ""), (10**5 + 2, base[0] + "\n\n" + base[0])]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id long, text string, line string, no int").repartition(3)
    got = line_dedup.dedup_lines(df, threshold=k, min_bytes=10).select("doc_id", "n_lines", "n_removed", "n_near", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, 10)


def test_dedup_lines_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_default_takes_in_a_short_word(spark):
    line = "ne er tion of that orinre and then some more words follow here"
    texts = [line, line.replace("of that", "of at"), line.replace("and then", "and of then"), line.replace("then", "zzzz"), line.replace("some more", "quite another")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_near for r in line_dedup.dedup_lines(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def test_exact_repeats_of_short_lines(spark):
    docs = spark.createDataFrame([(1, "short\n\n  \nshort", "en", "s", 15), (2, "short\nshor\n\n  \t", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in line_dedup.stage(docs).collect()} == {1: "short\n\n  ", 2: "shor\n\n  \t"}


def test_lines_that_share_one_hash_are_judged_apart(spark):
    """With one hash the same for all lines, the near line alone is marked."""
    texts = ["the first line of some length that is here", "the first line of some lenght that is here", "another line, unlike either of the two others"]
    lines = spark.createDataFrame([(7, i, t, decimal.Decimal(i)) for i, t in enumerate(texts)] + [(8, 9, texts[0] + "s", decimal.Decimal(9))], "id long, b long, line string, first decimal(32,0)")
    assert sorted(tuple(r) for r in line_dedup.near_earlier(lines, 4, 32).collect()) == [(7, 1), (8, 9)]


def test_the_bit_parallel_distance_decides(spark, monkeypatch):
    """Lines that share a segment at equal lengths but are far apart stay, and go if the distance says so."""
    head = "a segment that is the same in both"
    docs = spark.createDataFrame([(1, head + "0123456789"), (2, head + "abcdefghij")], "doc_id long, text string")
    gone = lambda: sorted(r.n_removed for r in line_dedup.dedup_lines(docs).collect())
    assert gone() == [0, 0]
    monkeypatch.setattr(line_dedup, "within", lambda a, b, threshold: F.lit(True))
    assert gone() == [0, 1]


def test_far_strings_of_one_length_stop_early(spark):
    r = random.Random(5)
    rows = [(bytearray(r.choices(b"abcd", k=40)), bytearray(r.choices(b"abcd", k=40 - r.randrange(5)))) for _ in range(300)]
    rows += [(x, bytearray(x[i:])) for x, _ in rows[:60] for i in (0, 3, 4)]
    df = spark.createDataFrame([(*x, distance(*x) <= 4) for x in rows], "long binary, short binary, want boolean")
    assert df.where(line_dedup.within(F.col("long"), F.col("short"), 4) != F.col("want")).count() == 0


def test_lines_meet_their_texts_in_slices(spark, monkeypatch):
    """A slice's shuffle holds its own ids only; together the slices hold each line that has met another one."""
    names, plain = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "SLICES", 3)
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, codec=None: names.append((name, df.count())) or plain(df, name, codec))
    long = spark.createDataFrame([(i, f"line {i}") for i in range(-30, 30)], "id long, raw string")
    met = spark.createDataFrame([(i,) for i in range(-40, 40, 2)] * 2, "id long")
    assert sorted(r.id for r in line_dedup._members(long, met).collect()) == list(range(-30, 30, 2))
    assert names == [("lines-members", 10)] * 3


def test_keys_of_both_classes(spark):
    """A line near the begin of its class is keyed in the class below as well, there with displaced segments only."""
    lines = spark.createDataFrame([("x" * n,) for n in (32, 36, 38, 40, 43, 44, 50)], "line string")
    got = [r.c for r in lines.select(line_dedup.classes(F.octet_length("line"), 4, 32).alias("c")).collect()]
    assert got == [[32], [32], [32], [40, 32], [40, 32], [40], [50, 40]]


def test_distance_is_of_bytes(spark):
    """Also where they are no characters, and for the bytes of one character."""
    rows = [(bytearray(a), bytearray(b), distance(a, b) <= k, k) for a, b in ((b"\xff\x00abc\xc3\xa9" * 3, b"\xff\x00abc\xc3" * 3), ("é€ü".encode() * 4, "eeu€".encode() * 3)) for k in (1, 2, 3, 4)]
    for k in (1, 2, 3, 4):
        df = spark.createDataFrame([r[:3] for r in rows if r[3] == k], "a binary, b binary, want boolean")
        assert df.where(line_dedup.within(F.col("a"), F.col("b"), k) != F.col("want")).count() == 0
