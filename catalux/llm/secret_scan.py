"""Secrets: fixed patterns, and random strings that show by few characters a token.

Base kinds, each leftmost and without overlaps of its own kind, matches that fail their check dropped without a retry:
``assign`` (a name such as password, token or api_key, a colon or equals sign, and a value of 12 characters or more), ``access``
(``AKIA`` and capitals or digits, 18 characters or more) and ``hex`` (lower-case hex digits, 16 or more). A span is the whole match.

The method adds spans of kind ``random``. A proposal is a maximal run of ``CANDIDATE`` characters, ``SHORTEST`` or more, that
overlaps no base span. Left out are known digests (hex of a usual digest length in either case, ``sha256-`` and base64 of
its length), and identifiers: UUIDs, runs of only digits and marks, of letters of one case only, and those with few letters
(dates, part numbers). What is left is encoded by a tiktoken vocabulary, in parts of ``PART`` characters at most, so that time is
linear. Written language has 2.5 to 5 characters a token, joined names over 2, random strings under 2: less than ``RATIO``
is reported, with the ratio as score. Offsets are code points, ends exclusive.

Null or empty text: no spans. Each row stands for itself; null and repeated ids are kept as they are. Very long texts are looked
at whole, in linear time. Spans of one start go by kind as listed. No rows: no rows. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_steps, utf8, words

KINDS = ("assign", "access", "hex", "random")
# on UTF-8 bytes with A-Z lower-cased, whose offsets are those of the text; the value's characters are the same set in either case
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
SHORTEST = 20
RATIO = 2.0
PART = 256
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
INTEGRITY = {"sha256": 44, "sha384": 64, "sha512": 88}
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)
HEX = np.ones(256, bool)
HEX[list(b"0123456789abcdef")] = False
CANDIDATE = np.ones(256, bool)
CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = False
LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken encoding of a file of ranks, once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(s: str) -> bool:
    """A digest or an identifier by its form."""
    bare = s.strip("=_-+/")
    if len(bare) in DIGESTS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare) or UUID.fullmatch(bare):
        return True
    head, _, rest = s.partition("-")
    if INTEGRITY.get(head) == len(rest):
        return True
    lower, upper, digit = (sum(a <= c <= b for c in s) for a, b in (("a", "z"), ("A", "Z"), ("0", "9")))
    return (lower + upper) * 4 < len(s) or not digit and not (lower and upper)


def characters_a_token(s: str, vocabulary: str) -> float:
    e = encoding(vocabulary)
    return len(s) / sum(len(e.encode_ordinary(s[i : i + PART])) for i in range(0, len(s), PART))


def _runs(raw: np.ndarray, gap: np.ndarray, least: int) -> list[tuple[int, int]]:
    start, end, _ = words(raw, np.array([0, len(raw)]), gap)
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """Base spans as byte offsets."""
    low = text.translate(LOW)
    out = [("assign", *m.span()) for m in ASSIGN.finditer(low) if m.end() - m.start(1) >= LEAST_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", a, b) for a, b in _runs(np.frombuffer(text, np.uint8), HEX, LEAST_HEX)]


def random_spans(text: bytes, base: list[tuple[str, int, int]], vocabulary: str, ratio: float = RATIO) -> list[tuple[str, int, int, float]]:
    """Proposals beside the base spans, with their characters a token."""
    out = []
    taken, at = sorted((a, b) for _, a, b in base), 0
    end = 0  # the furthest end of the base spans that begin before the proposal ends
    for a, b in _runs(np.frombuffer(text, np.uint8), CANDIDATE, SHORTEST):
        while at < len(taken) and taken[at][0] < b:
            end = max(end, taken[at][1])
            at += 1
        if end > a:
            continue
        s = text[a:b].decode("ascii")
        if not known(s) and (x := characters_a_token(s, vocabulary)) < ratio:
            out.append(("random", a, b, x))
    return out


ORDER = {k: i for i, k in enumerate(KINDS)}


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scored array<struct<start: int, end: int, characters_a_token: double>>"


def find_secrets(docs: DataFrame, vocabulary: str, ratio: float = RATIO) -> DataFrame:
    """Per row: counts of base spans, their digest, all spans as a string, and the added spans with their scores."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("characters_a_token", pa.float64())]))
        for b in text_steps(batches, 4 << 20):
            raw, offsets = utf8(b.column("text"))
            counts, shas, spans, scored = [[], [], []], [], [], []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = raw[i:j].tobytes()
                base = base_spans(text)
                more = random_spans(text, base, vocabulary, ratio)
                if (base or more) and not text.isascii():  # bytes to code points
                    point = np.zeros(j - i + 1, np.int64)
                    np.cumsum((raw[i:j] & 0xC0) != 0x80, out=point[1:])
                    base = [(k, int(point[a]), int(point[e])) for k, a, e in base]
                    more = [(k, int(point[a]), int(point[e]), x) for k, a, e, x in more]
                for n, k in zip(counts, KINDS, strict=False):
                    n.append(sum(x[0] == k for x in base))
                shas.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + [x[:3] for x in more]))
                scored.append([{"start": a, "end": e, "characters_a_token": x} for _, a, e, x in more])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(n, pa.int64()) for n in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(scored, kind)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scored"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(find, FOUND)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"), default_vocabulary()).drop("scored")
