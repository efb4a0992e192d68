"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score.

Base kinds are email, ip, card and phone, each leftmost and without overlaps of its own kind, with its own
check (parts of at most 255; 12 to 19 digits that pass Luhn; 9 to 15 digits). The method adds spans of the
kinds ``iban`` (mod-97, as long as its country's are), ``ssn`` and ``secret``: a proposal has a score by its checksum or form,
whole words in the ``CONTEXT`` characters before and after it raise it, words that point elsewhere lower it, and it is reported from
``THRESHOLD`` on. Base spans have scores as well, but stay in any case. Offsets are code points, ends exclusive.

Null or empty text: no spans. Each row stands for itself; null and repeated ids are kept as they are. Very long texts are
looked at whole, in linear time: a pattern that failed at the first digit of a run is not tried at the others. No rows: no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_steps

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
# fixed values: characters of an account number by country (public registry of ISO 13616)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# of a country that isn't there the whole run counts
IBAN_BODY = {n: re.compile(r"(?:\x20?[A-Z0-9]){%s}(?![A-Za-z0-9])" % (f"{n - 4}" if n else "11,30")) for n in {0, *IBAN_LENGTHS.values()}}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_+/=-])")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
CONTEXT = 40
THRESHOLD = 0.75
#: Words near a proposal that raise or lower its score.
RAISE = {
    "email": ("mail", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "payment"), "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"), "secret": ("token", "key", "secret", "password", "passwd", "apikey", "bearer"),
}
LOWER = ("sha", "sha256", "md5", "checksum", "commit", "version", "isbn", "order")
WORD = re.compile(r"[a-z0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL.finditer gives, but only looked for around each @."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(int(x) <= 255 if len(x) < 4000 else not x.strip("0") for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def nearby(text: str, start: int, end: int) -> set[str]:
    """The words, lower-cased, that lie whole in the ``CONTEXT`` characters on either side of a span."""
    a, b = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    while 0 < a < start and text[a - 1].isalnum() and text[a].isalnum():
        a += 1
    while end < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b -= 1
    return {*WORD.findall(text[a:start].lower()), *WORD.findall(text[end:b].lower())}


def score(kind: str, text: str, start: int, end: int, confirmed: float) -> float:
    near = nearby(text, start, end)
    up, down = any(w in near for w in RAISE[kind]), any(w in near for w in LOWER)
    return max(0.0, min(1.0, confirmed + 0.3 * up - 0.3 * down))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, leftmost first and without overlaps: as many characters as their country has, then mod-97."""
    done = 0
    for m in IBAN.finditer(text):
        if m.start() < done:
            continue
        body = IBAN_BODY[IBAN_LENGTHS.get(m[1], 0)].match(text, m.end())
        if body and mod97(text[m.start() : body.end()]):
            done = body.end()
            yield m.start(), done


def more_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Proposals of the added kinds whose score reaches the threshold."""
    out = [("iban", a, b, score("iban", text, a, b, 0.9)) for a, b in ibans(text)]
    for m in SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            out.append(("ssn", *m.span(), score("ssn", text, *m.span(), 0.5)))
    for m in SECRET.finditer(text):
        letters = sum(c.isalpha() for c in m.group())
        if letters >= 4 and len(set(m.group())) >= 8:
            out.append(("secret", *m.span(), score("secret", text, *m.span(), 0.5)))
    return [x for x in out if x[3] >= THRESHOLD]


ORDER = {k: i for i, k in enumerate(KINDS)}


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scored array<struct<kind: string, start: int, end: int, score: double>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for b in text_steps(batches, 4 << 20):
        counts, shas, spans, scored = [[], [], [], []], [], [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            more = more_spans(text)
            for n, k in zip(counts, KINDS, strict=False):
                n.append(sum(x[0] == k for x in base))
            shas.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(base + [x[:3] for x in more]))
            scored.append([{"kind": k, "start": a, "end": e, "score": score(k, text, a, e, 0.6)} for k, a, e in base] + [{"kind": k, "start": a, "end": e, "score": s} for k, a, e, s in more])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(n, pa.int64()) for n in counts], pa.array(shas), pa.array(spans), pa.array(scored, kind)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scored"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: counts of base spans, their digest, all spans as a string and, scored, as a list."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_find, FOUND)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    return found.withColumn("scores", F.to_json("scored")).drop("scored")
