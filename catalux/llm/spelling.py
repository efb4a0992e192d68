"""Spelling variants: words of the corpus that differ by one code point, and the commoner spelling of each.

1. ``vocabulary`` counts words: maximal runs of letters (``A-Z``, ``a-z``, U+00C0 to U+00FF), A-Z lower-cased. Of one run in
   ``noise`` (by a checksum of document and run) one letter is dropped first, which gives a known share of misspellings.
2. ``near_pairs`` keeps a positional index of bigrams. A word's tokens are its bigrams with their positions, rarest bigram
   first. One edit destroys at most ``Q`` = 2 tokens of a word, moves the tokens behind it by one place and keeps their order.
   So of two near words the first ``depth`` tokens that both have lie among the first ``Q + depth`` of either, and postings are
   kept only for the sets of ``depth`` of those (*paths*): length, bigrams and positions are the key. A word probes the
   lists of its own length, and with each way its positions may have moved those of the length above.
   The lists come together by Spark's external merge sort (a heap over sorted runs). Pairs of a list go through the count
   filter (at least length - 3 tokens in common, positions at most one apart) and are then verified letter by letter.
   A pair is reported by the one path that its first common tokens make, so nothing has to be told apart later.
3. A list of more than ``BLOCK`` rows isn't compared; its words go one token deeper, round by round. At the depth of all
   tokens that near words must have in common at most two letters of a word are free, which bounds a list by the alphabet.
4. ``forms`` takes the near word of largest count; ``roots`` follows forms. As a form is at least ``ratio`` (over 1) times as
   frequent, chains are short (logarithmic in the corpus).

Null texts have no words. Null ids count as the text ``null`` before the colon of the checksum. Rows that repeat an id are texts
of their own. Very long texts and words are looked at whole. Ties of the count go to the smallest word in code-point order.
No words: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checksum import CRC_SQL, crc32, crc32_sql, joined
from .common import LOWER, materialize, mix, read, text_steps, utf8, words

NOISE = 31
LEAST_POINTS = 7
LEAST_COUNT = 2
RATIO = 10
Q = 2
DEPTH = 2
BLOCK = 1024
#: Letters are numbered from 1: a to z, then U+00C0 to U+00FF, whose UTF-8 is C3 and one byte from 80 to BF.
LETTERS = 26 + 64
CODE = np.zeros(256, np.uint8)
CODE[0x61:0x7B] = np.arange(1, 27)
CODE[0x80:0xC0] = np.arange(27, 91)
LEAD = 0xC3
GRAMS = (LETTERS + 1) ** 2
#: Rows that are compared at a time.
ROWS = 1 << 15


def letters(raw: np.ndarray) -> np.ndarray:
    low = LOWER[raw]
    inside = (low >= 0x61) & (low <= 0x7A)
    lead = low == LEAD
    inside |= lead
    inside[1:] |= lead[:-1]
    return inside


def noisy_words(raw: np.ndarray, offsets: np.ndarray, ids: list[int | None], noise: int, least: int) -> pa.Array:
    """All words of the texts that have ``least`` code points after the noise."""
    if not len(raw):
        return pa.array([], pa.string())
    low, inside = LOWER[raw], letters(raw)
    start, end, first = words(inside.view(np.uint8), offsets, np.arange(256) == 0)
    point = inside & ((low < 0x80) | (low >= 0xC0))
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(point, out=before[1:])
    length = before[end] - before[start]
    if noise:
        heads = [f"{'null' if i is None else i}:".encode() for i in ids]
        joint = np.frombuffer(b"".join(heads), np.uint8)
        stop = np.cumsum([len(h) for h in heads])
        head = crc32(joint, stop - np.array([len(h) for h in heads]), stop)
        h = joined(np.repeat(head, np.diff(first)), crc32(low, start, end), end - start)
        hit = np.flatnonzero(h % np.uint32(noise) == 0)
        where = np.flatnonzero(point)  # byte of each letter
        drop = where[before[start[hit]] + h[hit] % length[hit]]
        keep = inside.copy()
        keep[drop] = False
        two = drop[low[drop] == LEAD]
        keep[two + 1] = False
        length[hit] -= 1
    else:
        keep = inside
    kept = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    size = kept[end] - kept[start]
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    found = pa.StringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(low[keep]))
    return found.filter(pa.array(length >= least))


def vocabulary(docs: DataFrame, noise: int = NOISE, least: int = LEAST_POINTS, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least ``least`` code points that occur ``count`` times; counts of a batch are added up before the shuffle."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, 1 << 20):
            got = pc.value_counts(noisy_words(*utf8(b.column("text")), b.column("doc_id").to_pylist(), noise, least))
            yield pa.RecordBatch.from_arrays([got.field(0), got.field(1)], ["word", "n"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(find, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _classes(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per word length of a batch: the length, its rows, and the letters of those as a matrix."""
    raw, offsets = utf8(b.column("word"))
    flat = CODE[raw[raw != LEAD]]
    skipped = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == LEAD, out=skipped[1:])
    at = offsets - skipped[offsets]
    size = np.diff(at)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield int(n), rows, flat[at[rows][:, None] + np.arange(n)]


def bigrams(letter: np.ndarray) -> np.ndarray:
    return letter[:, :-1].astype(np.int16) * np.int16(LETTERS + 1) + letter[:, 1:]


def rarity(words: DataFrame) -> np.ndarray:
    """Rank of each bigram by the number of words that hold it, the rarest first; a table of GRAMS entries at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for b in batches:
            for n, _, letter in _classes(b):
                if n > 1:
                    total += np.bincount(bigrams(letter).ravel(), minlength=GRAMS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])

    total = np.zeros(GRAMS, np.int64)
    for r in words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[r.gram] = r.n
    rank = np.empty(GRAMS, np.int64)
    rank[np.argsort(total, kind="stable")] = np.arange(GRAMS)
    return rank


def first_tokens(letter: np.ndarray, rank: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and positions of the ``many`` rarest tokens of each word of one length."""
    g = rank[bigrams(letter)]
    order = np.argsort(g, axis=1, kind="stable")[:, :many]  # equal bigrams stay in the order of positions
    return np.take_along_axis(g, order, 1), order


POSTING = "size int, path long, word string, n long, at binary"


def postings(words: DataFrame, rank: np.ndarray, depth: int) -> DataFrame:
    """A row for each path of a word: for its own length (size), and shifted for the length above."""
    deeper = "at" in words.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for big in batches for c in _pieces(big)):
            if deeper:
                target, old_path = np.asarray(b.column("size")), np.asarray(b.column("path"))
                old = np.frombuffer(b"".join(b.column("at").to_pylist()), "<i4").reshape(-1, depth - 1)
            for n, rows, letter in _classes(b):
                ranks, places = first_tokens(letter, rank, Q + depth)
                size, path, row, at = [], [], [], []
                for some in itertools.combinations(range(min(Q + depth, n - 1)), depth):
                    r, p = ranks[:, some], places[:, some]
                    by_place = np.argsort(p, axis=1, kind="stable")
                    turn = np.argsort(by_place, axis=1, kind="stable")  # number of each token by position
                    for moved in range(depth + 1):  # 0: own length; else so many of the tokens keep their place, or none
                        for up in (0, 1) if moved == depth else (1,):
                            q = p + (turn >= moved) if up else p
                            mine = np.arange(len(p))
                            h = np.full(len(p), n + up, np.uint64)
                            for k in range(depth):
                                if deeper and k == depth - 1:  # only for the list that was too long
                                    mine = np.flatnonzero((target[rows] == n + up) & (h.view(np.int64) == old_path[rows]) & (q[:, :-1] == old[rows]).all(1))
                                    h = h[mine]
                                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (r[mine, k] * (1 << 32) + q[mine, k]).astype(np.uint64))
                            if not len(mine):
                                continue
                            size.append(np.full(len(mine), n + up, np.int32))
                            path.append(h.view(np.int64))
                            row.append(rows[mine])
                            at.append(q[mine].astype("<i4"))
                if not row:
                    continue
                row, at, path, size = np.concatenate(row), np.concatenate(at), np.concatenate(path), np.concatenate(size)
                once = np.unique(np.stack([row, path, size.astype(np.int64)]), axis=1, return_index=True)[1]
                row, at, path, size = row[once], np.ascontiguousarray(at[once]), path[once], size[once]
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.arange(len(row) + 1) * 4 * depth).astype(np.int32)), pa.py_buffer(at)])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(path), b.column("word").take(take), b.column("n").take(take), data], ["size", "path", "word", "n", "at"])

    return words.mapInArrow(emit, POSTING)


def _pieces(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of some thousand words, fewer if they are long."""
    each = max(1, min(4000, int(most // max(1, b.nbytes / max(1, b.num_rows)))))
    for i in range(0, b.num_rows, each):
        yield b.slice(i, each)


def compared(size: int, path: np.ndarray, longer: np.ndarray, letter: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (row numbers) within lists of one target length.

    Rows are sorted by path, words of length ``size - 1`` (``longer`` false, padded with 0) before those of length ``size``.
    """
    gram = bigrams(letter)
    new = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    begin = np.repeat(new, np.diff(np.append(new, len(path))))
    live, d, out = np.flatnonzero(longer), 0, []
    bound = size - 1 - Q
    while True:
        d += 1
        live = live[live - d >= begin[live]]
        if not len(live):
            break
        for i in range(0, len(live), ROWS):
            y = live[i : i + ROWS]
            x = y - d
            equal = longer[x]
            for same in (True, False):
                yy, xx = y[equal == same], x[equal == same]
                if not len(yy):
                    continue
                a, b = gram[xx], gram[yy]
                # the count filter: tokens in common, at the same place or, in the longer word, one further
                common = (a == b).sum(1) if same else ((a[:, :-1] == b[:, :-1]) | (a[:, :-1] == b[:, 1:])).sum(1)
                some = common >= bound
                yy, xx = yy[some], xx[some]
                if not len(yy):
                    continue
                differ = letter[xx] != letter[yy]
                edit = differ.argmax(1)
                if same:
                    near = differ.sum(1) == 1
                else:  # behind the first difference the shorter word goes on one place earlier
                    behind = np.arange(size - 1)[None, :] >= edit[:, None]
                    near = ((letter[xx][:, :-1] == letter[yy][:, 1:]) | ~behind).all(1)
                yy, xx, edit = yy[near], xx[near], edit[near]
                if len(yy):
                    g = rank[gram[yy]]
                    places = np.arange(size - 1)[None, :]
                    g = np.where((places == edit[:, None]) | (places == edit[:, None] - 1), np.iinfo(np.int64).max, g)
                    own = np.argsort(g, axis=1, kind="stable")[:, : at.shape[1]]
                    mine = ((own == at[yy]) & (own == at[xx])).all(1)
                    out.append((xx[mine], yy[mine]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


FOUND = "size int, path long, word string, n long, at binary, near string, near_n long"


def settled(sorted_postings: DataFrame, rank: np.ndarray, depth: int, block: int) -> DataFrame:
    """Near pairs, in both directions, of the lists of up to ``block`` rows; the rows of longer lists as they are (near null)."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
        """Whole lists of together about ROWS rows (True), or rows of a list that is too long (False). Holds block + ROWS rows at most."""
        held: list[pa.RecordBatch] = []
        hot = None
        for b in itertools.chain((c for big in batches for c in _pieces(big)), [None]):
            if b is not None:
                held.append(b)
                if sum(x.num_rows for x in held) < ROWS and sum(x.nbytes for x in held) < 8 << 20:
                    continue
            if not held:
                break
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            size, path = np.asarray(whole.column("size")), np.asarray(whole.column("path"))
            begin = np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (path[1:] != path[:-1])))
            cuts = np.append(begin, len(size)).tolist()
            long = (np.diff(cuts) > block) & (size[begin] - 1 - Q > depth)  # else it is as deep as it goes
            long[0] |= hot == (size[0], path[0])
            hot = (size[-1], path[-1]) if long[-1] else None
            held = [] if b is None or long[-1] else [whole.slice(cuts[-2])]
            done, end = 0, cuts[-2] if held else cuts[-1]
            for i in np.flatnonzero(long).tolist():
                if cuts[i] > done:
                    yield True, whole.slice(done, cuts[i] - done)
                yield False, whole.slice(cuts[i], cuts[i + 1] - cuts[i])
                done = cuts[i + 1]
            if end > done:
                yield True, whole.slice(done, end - done)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["size", "path", "word", "n", "at", "near", "near_n"]
        for whole, b in lists(batches):
            if not whole:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.int64())], names)
                continue
            target = np.asarray(b.column("size"))
            cuts = np.flatnonzero(np.append(True, target[1:] != target[:-1])).tolist() + [len(target)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                c = b.slice(i, j - i)
                size = int(target[i])
                path = np.asarray(c.column("path"))
                letter = np.zeros((j - i, size), np.uint8)
                longer = np.zeros(j - i, bool)
                for n, rows, own in _classes(c):
                    letter[rows, :n] = own
                    longer[rows] = n == size
                at = np.frombuffer(b"".join(c.column("at").to_pylist()), "<i4").reshape(-1, depth)
                order = np.lexsort((longer, path))
                x, y = compared(size, path[order], longer[order], letter[order], at[order], rank)
                x, y = order[x], order[y]
                one, two = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
                word, n = c.column("word"), c.column("n")
                none = pa.nulls(len(one), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(one), pa.int32()), none, word.take(one), n.take(one), pa.nulls(len(one), pa.binary()), word.take(two), n.take(two)], names)

    return sorted_postings.mapInArrow(find, FOUND)


def near_pairs(words: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words (distinct rows of word, n) that are one edit apart."""
    rank, found, rows = rarity(words), [], words.select("word", "n")
    while True:
        lists = postings(rows, rank, depth).repartition("size", "path").sortWithinPartitions("size", "path")
        out = materialize(settled(lists, rank, depth, block), f"near-{depth}")
        found.append(out.where("near is not null").select("word", "n", "near", "near_n"))
        rows = out.where("near is null")
        if rows.isEmpty():
            break
        depth += 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    return pairs


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest count, if its count is ``ratio`` times the word's."""
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    by_word = pairs.unionAll(none).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    top = -F.col("best.less")
    chosen = top >= F.lit(ratio) * F.col("n")
    return by_word.select("word", "n", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, top).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """root: the end of the chain of forms, by joins until no chain goes on."""
    edges = formed.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("then"))
    now = materialize(formed.withColumn("root", F.coalesce("form", "word")), "roots")
    while True:
        moved = now.where("form is not null").join(edges, F.col("root") == F.col("at"), "left").withColumns({"root": F.coalesce("then", "root"), "on": F.col("then").isNotNull()}).drop("at", "then")
        moved = materialize(moved.unionByName(now.where("form is null").withColumn("on", F.lit(False))), "roots")
        now = moved.drop("on")
        if moved.where("on").isEmpty():
            return now


def variants(docs: DataFrame, noise: int = NOISE, least: int = LEAST_POINTS, count: int = LEAST_COUNT, ratio: int = RATIO, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the vocabulary."""
    if least < depth + Q + 1 or ratio < 2:
        raise ValueError("words need depth + 3 code points at least, forms a ratio of 2")
    words = materialize(vocabulary(docs, noise, least, count), "vocabulary")
    return roots(materialize(forms(words, near_pairs(words, depth, block), ratio), "forms"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') || ':' AS head,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT head, w, count(*) AS n, hex(encode(head || w)) AS h FROM runs GROUP BY head, w),
hashed AS (SELECT w, n, {crc32_sql("h")} AS crc FROM counted, crc),
noisy AS (SELECT CASE WHEN crc % {NOISE} = 0 THEN substr(w, 1, (crc % length(w))::INT) || substr(w, (crc % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM noisy WHERE length(word) >= {LEAST_POINTS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, w.word, w.n FROM holes x JOIN words w ON x.a || x.b = w.word
  UNION SELECT w.word, x.word, x.n FROM holes x JOIN words w ON x.a || x.b = w.word),
ranked AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM words LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (word)),
chains AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""
