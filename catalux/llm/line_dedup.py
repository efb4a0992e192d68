"""Line dedup: a segment-partition edit join, in DataFrame functions only.

A line is a piece of a text between ``\\n``. Lines of ``min_bytes`` UTF-8 bytes or more take part; of shorter ones
that are not blank exact repeats go, from ``exact_bytes`` on, if given. A line goes if an earlier one, by (doc_id, number), is equal or within ``threshold`` edits of bytes. Lines are
judged on the input: an earlier line counts even if it goes itself.

1. Equal lines are aggregated to their first position: what follows sees distinct lines only.
2. Lengths fall into classes whose bounds grow by a quarter. The first bytes of a line, as many as its class has at
   least, are cut into threshold + 1 equal segments. Of two lines within the threshold one segment of the shorter
   occurs in the longer near its place: if i is the first number for which the first i segments have fewer than i
   edits, segment i has none and is displaced by less than i; the edits that are left bound the displacement from
   the other side. Keys are hashes of (class, segment number, bytes): a line's own segments, and displaced
   substrings that it is probed with, in the class of lines up to ``threshold`` bytes shorter too.
3. Keys are dealt out once; those of one line only fall away by a window of the key.
4. The lines of a key meet in blocks of ``BLOCK``: a key of m lines makes m / BLOCK rows for each, never pairs. In a block pair
   each line looks for an earlier one, by length and by counts of letters, which no two lines within the threshold fail, then by the
   banded distance of what differs, which decides. A pair is verified under the first key that it has in common only.

Lines are told apart by two 64-bit hashes. While keys are looked for one of them stands for a line: two near lines that agree in
it, and share no key with a third line, would not meet, a chance of 2 ** -64 for each near pair.

Null or empty texts have one empty line. Null ``doc_id``: kept whole, and no source. Rows of one id are separate
documents; of two lines at the same (doc_id, number) neither is earlier. Columns of the input may have any names; n_lines,
n_removed, n_near and kept are replaced. An empty table gives an empty one. Very long lines are compared whole.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, materialize, read, release

#: Takes in a changed, added or dropped short word.
THRESHOLD = 4
MIN_BYTES = 32
#: Of exact repeats: lines that are not blank and have so many bytes.
EXACT_BYTES = 1


def _doc_id() -> Column:
    return F.col("doc_id").try_cast("long")


def _place() -> Column:
    """(doc_id, no) as one number, in their order: a hash aggregate can hold its minimum."""
    return (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("no").cast("decimal(10,0)")).cast("decimal(32,0)")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, no, line) of the lines of rows with an id and a text; ``t`` tells the texts of one id apart."""
    src = docs.select(_doc_id().alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return src.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("no", "line"))


def _taken(lines: DataFrame, min_bytes: int, exact_bytes: int | None = None) -> DataFrame:
    taken = F.octet_length("line") >= min_bytes
    if exact_bytes is not None:
        taken = taken | ((F.octet_length("line") >= exact_bytes) & F.expr(r"trim(BOTH ' \t\r' FROM line) <> ''"))
    return lines.where(taken)


#: Lines of one key that meet at a time.
BLOCK = 64
#: Each class of lengths begins at so many times the begin of the class before it.
GROWTH = 1.25
#: Keys of a line and class that are dealt out together (those of one segment number at least): shuffles of one round are gone before the next.
ROUND = 5
#: Passes in which the lines of some key meet their texts.
SLICES = 2
#: Letters that are counted, by their frequency in prose: three bits each fill a long.
COUNTED = " eanirtsodlucmpghvyqk"
#: The codes of 0 to 5 as octal digits, the last first: the next count, modulo 6, differs in one bit.
CODES = 0o467310


def length_class(length: Column, least: int) -> Column:
    """The least length of the class that a length (``least`` or more) is in."""
    begin = lambda c: F.floor(F.lit(float(least)) * F.pow(F.lit(GROWTH), c)).cast("int")
    c = F.floor(F.log(length / F.lit(float(least))) / math.log(GROWTH))
    return F.when(begin(c + 1) <= length, begin(c + 1)).when(begin(c) <= length, begin(c)).otherwise(begin(c - 1))


def displacements(i: int, threshold: int) -> range:
    """Where the i-th segment of the shorter line may be in the longer one."""
    return range(max(-(i - 1), i - threshold - 1), min(i - 1, 2 * threshold + 1 - i) + 1)


def segment(raw: Column, begin: Column, threshold: int, i: Column | int, s: Column | int = 0) -> Column:
    """The bytes of the i-th segment of a class, displaced by s."""
    w = (begin / (threshold + 1)).cast("int")
    return F.substring(raw, w * (i - 1) + 1 + s, w)


def keys(threshold: int, numbers: range) -> tuple[Column, int]:
    """Array of keys of the segments of these numbers (from 1) in the class that begins at ``begin``, displaced ones after those in place.

    Of the columns ``raw`` and ``begin``. The number of those in place, too.
    """
    shifts = [(i, s) for i in numbers for s in displacements(i, threshold) if s]
    # a few expressions at a time: 20 and more are too long for the JIT
    return F.array(*[F.xxhash64("begin", F.lit(i), segment(F.col("raw"), F.col("begin"), threshold, i, s)) for i, s in [*((i, 0) for i in numbers), *shifts]]), len(numbers)


def sketch(line: Column) -> Column:
    """A number of 63 bits of which an edit changes two at most: it adds one to a count or takes one off, or does both."""

    def step(s: Column, letter: Column) -> Column:
        n = F.octet_length(line) - F.octet_length(F.replace(line, letter, F.lit("")))
        code = F.call_function("shiftright", F.lit(CODES), (3 * (n % 6)).cast("int")).bitwiseAND(F.lit(7)).cast("long")
        return F.shiftleft(s, 3).bitwiseOR(code)

    return F.aggregate(F.array(*map(F.lit, COUNTED)), F.lit(0).cast("long"), step)


def rounds(threshold: int) -> list[range]:
    """Segment numbers, from 1 to threshold + 1, in runs with ``ROUND`` displacements at most, or of one number."""
    out: list[range] = []
    for i in range(1, threshold + 2):
        if out and sum(len(displacements(j, threshold)) for j in (*out[-1], i)) <= ROUND:
            out[-1] = range(out[-1].start, i + 1)
        else:
            out.append(range(i, i + 1))
    return out


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two byte strings is at most ``threshold``: the built-in banded distance, of bytes as characters."""
    characters = lambda x: F.decode(x, "ISO-8859-1")  # noqa: E731  (one for each byte)
    return F.levenshtein(characters(a), characters(b), threshold) >= 0


def near_lines(pairs: DataFrame, threshold: int) -> DataFrame:
    """The rows of ``pairs`` (long, short: byte strings) within ``threshold`` edits."""
    return pairs.where(_near("long", "short", threshold))


def _near(long: Column | str, short: Column | str, threshold: int) -> Column:
    """Whether the distance of what is left without common ends is at most ``threshold``."""
    long, short = (F.col(x) if isinstance(x, str) else x for x in (long, short))
    return F.exists(F.array(without_ends(long, short, threshold)), lambda z: within(z["l"], z["s"], threshold))


def without_ends(long: Column, short: Column, threshold: int) -> Column:
    """Struct (l, s): the two without common ends, which do not change the distance; s keeps ``threshold`` bytes or more.

    Common ends are found by bisection, up to 2 ** 21 bytes each.
    """
    most = F.length(short) - threshold
    part = {True: lambda c, k: F.substring(c, F.lit(1), k), False: lambda c, k: F.substring(c, -k, k)}

    def common(front: bool) -> Column:
        def step(n: Column, more: Column) -> Column:
            k = n + more
            return F.when((k <= most) & (part[front](long, k) == part[front](short, k)), k).otherwise(n)

        return F.aggregate(F.array(*[F.lit(1 << i) for i in range(20, -1, -1)]), F.lit(0), step)

    both = F.transform(F.array(F.struct(common(True).alias("p"), common(False).alias("q"))), lambda z: F.struct(z["p"].alias("p"), F.least(z["q"], most - z["p"]).alias("q")))
    return F.transform(both, lambda z: F.struct(*[F.substring(c, z["p"] + 1, F.length(c) - z["p"] - z["q"]).alias(n) for c, n in ((long, "l"), (short, "s"))]))[0]


def distinct_lines(docs: DataFrame, min_bytes: int, exact_bytes: int | None = None) -> DataFrame:
    """(line, first, n): each line that takes part, its first place and how often it is there."""
    lines = _taken(_lines(docs), min_bytes, exact_bytes)
    return lines.groupBy("line").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))


def classes(size: Column, threshold: int, min_bytes: int) -> Column:
    """The classes that a line is keyed in: its own, and that of lines ``threshold`` bytes shorter if it is another one."""
    return F.array_distinct(F.array(length_class(size, min_bytes), length_class(F.greatest(size - threshold, F.lit(min_bytes)), min_bytes)))


def _members(long: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of ``long`` whose id has met another one, in ``SLICES`` passes: the shuffle of one slice is gone before the next."""
    spark, ids = long.sparkSession, met.select("id").distinct()
    out = []
    for i in range(SLICES):
        mine = lambda df, i=i: df.where(F.pmod("id", F.lit(SLICES)) == i)
        out.append(materialize(mine(long).join(mine(ids), "id", "left_semi"), "lines-members", "zstd"))
        release(spark)
    return reduce(DataFrame.unionByName, out)


def near_earlier(lines: DataFrame, threshold: int, min_bytes: int) -> DataFrame:
    """(id, b) of the lines (id, b, line, first) that are within ``threshold`` edits of an earlier one.

    ``lines`` are read several times; their ``classes`` may be there.
    """
    long = lines.where(F.octet_length("line") >= min_bytes)
    if "classes" not in long.columns:
        long = long.withColumn("classes", classes(F.octet_length("line"), threshold, min_bytes))
    long = long.select("id", "b", "first", F.col("line").cast("binary").alias("raw"), "classes")
    found = []
    for numbers in rounds(threshold):
        dealt, own = keys(threshold, numbers)
        keyed = long.select("id", "raw", F.posexplode("classes").alias("below", "begin")).select("id", "below", F.posexplode(dealt).alias("at", "key"))
        keyed = keyed.select("id", "key", ((F.col("at") < own) & (F.col("below") == 0)).alias("own"))
        key = Window.partitionBy("key")
        met = keyed.withColumns({"lo": F.min("id").over(key), "hi": F.max("id").over(key), "any": F.max("own").over(key), "m": F.count("*").over(key)})
        found.append(materialize(met.where("any and lo < hi").groupBy("key", "id").agg(F.max("own").alias("own"), F.max("m").alias("m")), "lines-keys"))
        del keyed, met
        release(lines.sparkSession)
    met = reduce(DataFrame.unionByName, found)
    counted = _members(long, met).select("id", "b", "first", "raw", F.col("classes")[0].alias("mine"), sketch(F.col("raw").cast("string")).alias("sketch"))
    member = met.join(counted, "id")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    member = member.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int"))
    place = F.struct("id", "b", "own", "first", "block", F.length("raw").alias("size"), "raw", "mine", "sketch").alias("x")
    member = member.select("key", place, "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    group = member.groupBy("key", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q")).agg(F.collect_list("x").alias("xs"))

    def hit(x: Column, y: Column) -> Column:
        """Whether y is an earlier line near x; of two blocks only lines of different ones are compared."""
        more = x["size"] - y["size"]
        far = (F.col("p") == F.col("q")) | (x["block"] != y["block"])
        # the shorter line's own segment, of two of one length the earlier line's, is the one that is looked for
        pair = F.array(F.when(more >= 0, F.struct(x["raw"].alias("l"), y.alias("s"))).otherwise(F.struct(y["raw"].alias("l"), x.alias("s"))))
        alike = F.bit_count(x["sketch"].bitwiseXOR(y["sketch"])) <= 2 * threshold
        return alike & more.between(-threshold, threshold) & far & (y["first"] < x["first"]) & F.exists(pair, lambda z: here(z["l"], z["s"]) & _near(z["l"], z["s"]["raw"], threshold))

    def here(long: Column, short: Column) -> Column:
        """Whether the key is that of the first segment that the two have in common, so that a pair is verified once."""
        own = lambda i: segment(short["raw"], short["mine"], threshold, i)
        met = lambda i: F.exists(F.array(*map(F.lit, displacements(i, threshold))), lambda s: segment(long, short["mine"], threshold, i, s) == own(i))
        which = F.coalesce(*[F.when(met(i), F.xxhash64(short["mine"], F.lit(i), own(i))) for i in range(1, threshold + 2)], F.lit(0).cast("long"))
        return short["own"] & (which == F.col("key"))

    near = group.select(F.explode(F.filter("xs", lambda x: F.exists("xs", lambda y: hit(x, y)))).alias("x")).select("x.id", "x.b").distinct()
    near = materialize(near, "lines-near")
    del group, member
    release(lines.sparkSession)
    return near


def verdicts(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, exact_bytes: int | None = None) -> DataFrame:
    """(a, b, first, near): first place of each line that repeats or is near an earlier one."""
    size = F.octet_length("line")
    names = {"id": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line"), "classes": F.when(size >= min_bytes, classes(size, threshold, min_bytes))}
    lines = materialize(distinct_lines(docs, min_bytes, exact_bytes).withColumns(names), "lines", "zstd")
    release(docs.sparkSession)
    late = near_earlier(lines, threshold, min_bytes).withColumn("near", F.lit(True))
    both = lines.join(late, ["id", "b"], "left").where("n > 1 or near")
    return both.select(F.col("id").alias("a"), "b", "first", F.coalesce("near", F.lit(False)).alias("near"))


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, exact_bytes: int | None = None) -> DataFrame:
    """(doc_id, gone): the numbers of the lines that go, for each document with any."""
    judged = materialize(verdicts(docs, threshold, min_bytes, exact_bytes), "lines-verdicts")
    release(docs.sparkSession)
    lines = _taken(_lines(docs), min_bytes, exact_bytes).select("doc_id", "t", "no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    gone = lines.join(judged, ["a", "b"]).where(F.col("near") | (_place() > F.col("first")))
    return gone.groupBy("doc_id", "t").agg(F.collect_set("no").alias("gone"), F.count_distinct(F.when(F.col("near"), F.col("no"))).alias("n_near"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, exact_bytes: int | None = None) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_removed, n_near (removed lines whose text is near an earlier one) and kept (text)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_near", "kept")]
    # the text is there once, as it is in the row
    src = docs.select(F.struct(*own).alias("row"), _doc_id().alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    gone = materialize(removed_lines(docs, threshold, min_bytes, exact_bytes), "lines-gone")
    release(docs.sparkSession)
    joined = src.join(gone, ["doc_id", "t"], "left").withColumn("text", F.col("row").getField("text").cast("string"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    breaks = (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long")
    stay = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    found = joined.select("row", breaks.alias("n_lines"), n(F.size("gone")).alias("n_removed"), n(F.col("n_near")).alias("n_near"), kept.alias("kept"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in own], "n_lines", "n_removed", "n_near", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_near, kept_sha256."""
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), exact_bytes=EXACT_BYTES)
    return found.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``: texts without the lines that go; documents of which nothing is left go."""
    found = dedup_lines(docs.select(*DOC_COLUMNS), exact_bytes=EXACT_BYTES)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = found.where("n_removed = 0 or trim(BOTH ' \\t\\n\\r' FROM kept) <> ''").withColumn("text", text)
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


# places of a line: (doc_id, no); near lines are looked for among those that have one of five parts in common, which loses none:
# four edits leave one part as it is.
OP6_SQL = """
WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
e AS (SELECT * FROM l WHERE strlen(line) >= 32 OR trim(line, ' ' || chr(9) || chr(13)) <> ''),
f AS (SELECT line, strlen(line) AS n, CAST(length(line) // 5 AS INTEGER) AS w, min(struct_pack(doc_id := doc_id, no := no)) AS first FROM e GROUP BY line),
g AS (SELECT * FROM f WHERE n >= 32),
near AS (SELECT DISTINCT CASE WHEN y.first < x.first THEN x.line ELSE y.line END AS line FROM g x JOIN g y ON y.n BETWEEN x.n - 4 AND x.n + 4 AND x.line < y.line
         AND (contains(y.line, x.line[1:x.w]) OR contains(y.line, x.line[x.w + 1:2 * x.w]) OR contains(y.line, x.line[2 * x.w + 1:3 * x.w]) OR contains(y.line, x.line[3 * x.w + 1:4 * x.w]) OR contains(y.line, x.line[4 * x.w + 1:5 * x.w]))
         AND levenshtein(x.line, y.line) <= 4),
gone AS (SELECT e.doc_id, count(DISTINCT e.no) AS n_removed, count(DISTINCT CASE WHEN near.line IS NOT NULL THEN e.no END) AS n_near, list(DISTINCT e.no) AS nos
         FROM e JOIN f ON e.line = f.line LEFT JOIN near ON e.line = near.line WHERE near.line IS NOT NULL OR struct_pack(doc_id := e.doc_id, no := e.no) > f.first GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
       sha256(array_to_string(list_transform(list_filter(list_zip(string_split(coalesce(text, ''), chr(10)), range(0, len(string_split(coalesce(text, ''), chr(10))))), lambda x: NOT list_contains(coalesce(nos, []), x[2])), lambda x: x[1]), chr(10))) AS kept_sha256
FROM documents d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""
