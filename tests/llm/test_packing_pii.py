"""Packing against the tokenizer itself; personal data against plain patterns."""

import hashlib
import random
import re
import zlib

import numpy as np

from catalux.llm import packing, pii

TEXTS = [
    "It's a Test, isn't it?  1234 été été ẞİ straße", "", None, "a", "x <|endoftext|> y<|startoftext|>z", "\x1c\x1d a b c\x85d", "THE!! THE!!***%%% a|b",
    "你好 \U0001f600 ١٢", "word " * 9000, "don't we'll I'D they'RE", "ﬁne Å Ω", "q" * 3000,
]


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, x, "n") for i, x in enumerate(TEXTS)], "doc_id long, text string, length string").repartition(3)
    rows = packing.pack(df, path, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for i, x in enumerate(TEXTS):
        want = t.encode(x or "", add_special_tokens=False).ids + [2]
        got = [int(k) for _, ids, _ in sorted(by[i], key=lambda p: p[0]) for k in ids]
        assert got == want and {n for _, _, n in by[i]} == {len(want)}
    lengths = {}
    for r in rows:
        lengths.setdefault(r.length, []).append(r.sequence_id)
    assert all(max(v) - min(v) + 1 == len(v) for v in lengths.values())


def test_packing_empty_and_null(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string"), path).collect()
    assert sum(r.length for r in rows) == 5


def test_binary_lengths():
    for n in range(1, 10000, 7):
        x = packing.binary_lengths(n)
        assert sum(x) == n and x == sorted(x, reverse=True)


def plain(text):
    """The base kinds by the patterns as the contract states them, not by those of the module."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    for kind, p in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if 12 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    r = random.Random(4)
    parts = ["@", ".", "a", "b.c", "@x.de", "foo@bar.example.com", " ", "-", "+", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "٣", "é", "%", "(", ")", "00", "378282246310005"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        assert sorted(pii.base_spans(text)) == plain(text), text


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("DE89370400440532013001")


def test_personal_data(spark):
    texts = ["é mail a.b@c.example.com, IBAN DE89 3704 0044 0532 0130 00.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "sha256 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "ssn 123-45-6789 and 987-65-4321", None, "", "9" * 5000, "1" * 5000 + ".1.1.1"]
    rows = pii.find_personal_data(spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(None, "a@b.c", 2)], "doc_id long, text string, spans long")).orderBy("doc_id").collect()
    got = {r.doc_id: r for r in rows}
    assert got[0].spans.split(",")[0] == "email:7:24" and ",iban:" in got[0].spans and got[0].n_email == 1
    assert got[0].base_sha256 == hashlib.sha256(b"email:7:24").hexdigest()
    assert got[1].spans.endswith("secret:9:49") and "secret" not in got[2].spans
    assert "ssn:4:15" in got[3].spans and "987" not in got[3].spans
    assert got[4].spans == got[5].spans == "" and got[None].n_email == 1


def test_long_runs_of_digits_take_linear_time():
    import time

    began = time.time()
    assert pii.base_spans("1" * 1_000_000) == []
    assert pii.base_spans("7" * 50 + ".1.2.3") == [] and pii.base_spans("x007.1.2.3.4") == [("ip", 1, 10)]
    assert time.time() - began < 20


def account(length, country, r):
    """An account number whose check digits are right."""
    body = "".join(r.choice("0123456789ABCXYZ") for _ in range(length - 4))
    digits = lambda x: "".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in x)
    return f"{country}{98 - int(digits(body + country + '00')) % 97:02d}{body}"


def test_account_numbers_end_at_their_countrys_length():
    r = random.Random(6)
    for country, length in (("DE", 22), ("NO", 15), ("MT", 31), ("GB", 22)):
        x = account(length, country, r)
        spaced = " ".join(x[i : i + 4] for i in range(0, length, 4))
        for text in (x, spaced, f"IBAN {x} IS MINE", f"{spaced} BIC DEUTDEFF", f"to {spaced}, {spaced}", f"{x} {x}"):
            want = [m.span() for m in re.finditer(f"{x}|{spaced}", text)]
            assert list(pii.ibans(text)) == want, text
        wrong = x[:-1] + ("0" if x[-1] != "0" else "1")
        for text in (wrong, f"{x}9", f"A{x}", x[:-1], f"{x[:-1]}é"):
            assert list(pii.ibans(text)) == [], text
    unknown = account(20, "QQ", r)
    assert list(pii.ibans(f"x {unknown}.")) == [(2, 22)]


def test_added_kinds_against_every_start():
    """Each start and end is tried, then leftmost spans without overlaps are kept."""
    r = random.Random(8)
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
    parts = ["123-45-6789", "000-45-6789", "123-45-", "6789", "-", " ", "ssn ", "token ", "commit ", "a1b2c3d4e5f6g7h8i9j0", "aaaaaaaaaaaaaaaaaaaa1", "Zq9", "_", "=", "é", "social"]

    def ssn(t):
        a, b, c = t[:3], t[4:6], t[7:]
        return t[3] == t[6] == "-" and all("0" <= x <= "9" for x in a + b + c) and a not in ("000", "666") and a < "900" and b != "00" and c != "0000"

    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        edge = lambda i, more: 0 <= i < len(text) and text[i] in more
        spans = [("ssn", i, i + 11) for i in range(len(text) - 10) if not edge(i - 1, "0123456789-") and not edge(i + 11, "0123456789-") and ssn(text[i : i + 11])]
        i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in word:
                j += 1
            t = text[i:j]
            stop = re.match("[A-Za-z_-]*", t).end()
            if j - i >= 20 and stop < len(t) and not edge(i - 1, "=/+") and not edge(j, "=/+") and sum(c.isalpha() for c in t) >= 4 and len(set(t)) >= 8:
                spans.append(("secret", i, j))
            i = max(j, i + 1)
        want = []
        for kind, a, b in spans:
            left, right = text[max(0, a - 40) : a], text[b : b + 40]
            if a > 40 and text[a - 41].isalnum():
                left = left.lstrip("".join(c for c in set(left) if c.isalnum()))
            if b + 40 < len(text) and text[b + 40].isalnum():
                right = right.rstrip("".join(c for c in set(right) if c.isalnum()))
            near = set(re.findall("[a-z0-9]+", f"{left.lower()}|{right.lower()}"))
            up = near & ({"ssn", "social", "security"} if kind == "ssn" else {"token", "key", "secret", "password", "passwd", "apikey", "bearer"})
            if up and not near & {"sha", "sha256", "md5", "checksum", "commit", "version", "isbn", "order"}:
                want.append((kind, a, b))
        assert sorted(x[:3] for x in pii.more_spans(text) if x[0] != "iban") == sorted(want), text


def test_context_on_both_sides_and_no_rows(spark):
    at = lambda t: [x[0] for x in pii.more_spans(t)]
    assert at("123-45-6789 is the SSN") == at("SSN: 123-45-6789") == ["ssn"] and at("123-45-6789") == at("ssn 123-45-6789 order") == []
    assert at("x" * 50 + "token " + "a1b2c3d4e5f6g7h8i9j0") == []  # a part of a word is no word
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
