"""Packing by power-of-two decomposition.

Each document's ids, with an end id, are cut into pieces of binary length: as many of ``longest`` as fit, then
one for each bit of the rest, the longest first. Pieces of equal length form a bucket; each is a sequence of
its own, so no sequence crosses documents and none needs padding.

Ids come from a tokenizer that drops white space. Texts are split at ASCII white space, which its pretokenizer never
joins, and the ids of each word are remembered, in a bounded table by worker; so the result is the
tokenizer's own. Null text: an empty text, whose ids are the end id alone. Rows of one ``doc_id``, or none, are packed
separately.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

LONGEST = 4096
END_ID = 2
#: Words, and letter sequences in them, whose ids a worker remembers.
MOST_WORDS = 600_000
_loaded: dict[str, WordIds] = {}


#: Words whose normal form and pieces are plain to see: printable ASCII but for the apostrophe, and Latin letters that no
#: normal form changes; their pieces are runs of letters, single digits, and runs of the rest.
SIMPLE = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
PIECE = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


def byte_names() -> dict[int, str]:
    """Names that byte-level vocabularies give to bytes that aren't printable: code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


class _Pieces(dict):
    def __init__(self, model) -> None:
        self.model, self.names = model, byte_names()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
        ids = self[piece] = np.array([x.id for x in self.model.tokenize(name)], np.uint16).tobytes()
        return ids


class _Words(dict):
    def __init__(self, tokenizer) -> None:
        self.whole, self.pieces = tokenizer, _Pieces(tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        text = word.decode()
        if SIMPLE.fullmatch(text) and "<|" not in text:  # which may begin a special token
            low = text.lower()
            ids = self.pieces[low] if low.isalpha() else b"".join([self.pieces[x] for x in PIECE.findall(low)])
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
        self[word] = ids
        return ids


class WordIds:
    """ids(text) as little-endian 16-bit numbers, equal to the tokenizer's with add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.words = _Words(Tokenizer.from_file(path))

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, falling, whose sum is n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, doc_tokens long, part int, pieces array<struct<start: long, length: long, ids_crc32: long, nth: long, ids: binary>>"


def _pieces(path: str, longest: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = word_ids(path), TaskContext.get().partitionId(), Counter()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())]))
        for b in batches:
            for c in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                total, rows = [], []
                for text in c.column("text").to_pylist():
                    ids = np.append(np.frombuffer(coder.ids((text or "").encode()), np.uint16), np.uint16(end_id)).astype("<u4")
                    at, row = 0, []
                    for n in binary_lengths(len(ids), longest):
                        raw = ids[at : at + n].tobytes()
                        row.append({"start": at, "length": n, "ids_crc32": zlib.crc32(raw), "nth": seen[n], "ids": raw if with_ids else None})
                        at += n
                        seen[n] += 1
                    total.append(len(ids)), rows.append(row)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(total, pa.int64()), pa.array([part] * len(total), pa.int32()), pa.array(rows, kind)], ["doc_id", "doc_tokens", "part", "pieces"])

    return run


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    ``sequence_id`` numbers the pieces gaplessly, bucket by bucket: each task counts its own pieces of a length, and
    sums of these counts over the tasks before it, one row a task and length, give where its numbers begin.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = materialize(src.mapInArrow(_pieces(tokenizer, longest, end_id, with_ids), PIECES), "packing")
    piece = held.select("doc_id", "doc_tokens", "part", F.explode("pieces").alias("p")).select("doc_id", "doc_tokens", "part", "p.*")
    count = piece.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    at, base = 0, []
    for r in sorted(count.groupBy("length").agg(F.sum("n").alias("n")).collect(), reverse=True):  # one row for each power of two
        base.append((r.length, at))
        at += r.n
    first = docs.sparkSession.createDataFrame(base, "length long, base long")
    count = count.select("length", "part", before.alias("before")).join(F.broadcast(first), "length")
    named = piece.join(count, ["length", "part"])
    return named.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("before") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
