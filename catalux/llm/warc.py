"""WARC archives and a two-level capture index.

``write_archives`` makes one ``.warc.gz`` a task, a gzip member a record, through the file system of the shared
folder. Records of equal payloads (of ``MIN_BYTES`` or more) as that of the least page are revisits that refer to
it. Files of attempts that fail are never listed, so a repeated task does no harm.

``build_index`` sorts the captures by reversed-host key into compressed blocks of ``BLOCK_LINES`` lines, in files of a
range of keys each, and gives the directory: first key, file, offset and length of each block. ``lookup`` finds the
blocks of a key by binary search in the directory, reads that range, finds the lines by binary search in
the block, and reads the range of each record. ``read_pages`` does so for a table of pages, an index file at a time; ``read_all`` goes
through every block and reads every record.

Null html: an empty payload. Null url: key "-". Null ``page_id``: a response that nothing refers to. Rows of one
``page_id`` and payload are all responses or refer to the same page. Very long payloads are records of their own length. No
pages: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, open_folder, read

MIN_BYTES = 100
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "first_key string, last_key string, n int, file string, offset long, length long, first_page long, last_page long"


def key_of(url: str | None) -> str:
    """Reversed host, then path and query: ``http://www.Example.com:80/a?b#c`` is ``com,example)/a?b``."""
    if not url:
        return "-"
    try:
        x = urlsplit(url.strip())
        host, port = (x.hostname or "").removeprefix("www."), x.port
    except ValueError:
        return quote(url, safe="/:?&=%")
    if not host:
        return quote(url, safe="/:?&=%")
    port = "" if port in (None, 80, 443) else f":{port}"
    return quote(",".join(reversed(host.split("."))) + port + ")" + (x.path or "/").lower() + ("?" + x.query.lower() if x.query else ""), safe="/:?&=%,)@!$'(*+;~")


def name_of(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URI)}")
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


URI = "".join(map(chr, range(0x21, 0x7F)))


def parse(raw: bytes) -> dict:
    """Headers and payload facts of one record; a response's digest is taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda s: int(m[1]) if (m := re.match(r"<urn:x-page:(-?\d+)>$", s or "")) else None
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        name, at, rows = f"part-{uuid.uuid4().hex}.warc.gz", 0, []
        out = None
        for b in batches:
            for page_id, url, html, to in zip(*(b.column(x).to_pylist() for x in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = gzip.compress(record(page_id, url, (html or "").encode(), to), 4, mtime=0)
                out.write(data)
                rows.append((key_of(url), page_id, name, at, len(data)))
                at += len(data)
        if out is not None:
            out.close()
            cols = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "page_id", "file", "offset", "length"])

    return run


def new_folder(spark: SparkSession, name: str) -> str:
    folder = new_path(spark, name)
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    return folder


#: Parts that the pages of a digest are cut into; the digests of several pages go to each.
SALTS = 16


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose digest an earlier page has. Only ids and digests are shuffled, and a digest's pages meet its first one in parts."""
    ids = pages.select("page_id", "digest").where("page_id is not null").distinct()
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"]).where("page_id > refers_to").select("page_id", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page; a stored table of the captures."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    src = src.withColumn("digest", F.unhex(F.sha2(body.cast("binary"), 256)))
    named = src.join(revisits(src.where(F.octet_length(body) >= MIN_BYTES)), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return materialize(named.mapInArrow(_write(folder), CAPTURE), "captures")


def _blocks(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        name, at, rows, out, held = f"index-{uuid.uuid4().hex}.cdx.gz", 0, [], None, []

        def flush() -> None:
            nonlocal at, held
            data = gzip.compress("".join("\t".join("" if v is None else str(v) for v in x) + "\n" for x in held).encode(), 6, mtime=0)
            out.write(data)
            rows.append((held[0][0], held[-1][0], len(held), name, at, len(data), held[0][1], held[-1][1]))
            at, held = at + len(data), []

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                held.append(x)
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            cols = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["first_key", "last_key", "n", "file", "offset", "length", "first_page", "last_page"])

    return run


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted, compressed blocks; the stored directory, one row a block."""
    n = captures.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = ("key", "page_id", "file", "offset")
    by = captures.repartitionByRange(int(n), *order).sortWithinPartitions(*order)
    return materialize(by.mapInArrow(_blocks(folder, lines), DIRECTORY), "directory")


def _lines(raw: bytes) -> list[tuple]:
    out = []
    for x in gzip.decompress(raw).decode().split("\n")[:-1]:
        key, page, file, offset, length = x.split("\t")
        out.append((key, int(page) if page else None, file, int(offset), int(length)))
    return out


def read_range(folder: str, file: str, offset: int, length: int) -> bytes:
    system, path = open_folder(folder)
    with system.open_input_file(f"{path}/{file}") as f:
        f.seek(offset)
        return f.read(length)


def lookup(folder: str, directory: list[tuple], url: str, index: str) -> list[dict]:
    """Records of a url, from the archives in ``folder`` by the index in ``index``. ``directory``: rows of ``DIRECTORY`` in order of first_key (a thousandth of the captures)."""
    key, found = key_of(url), []
    firsts = [r[0] for r in directory]
    lo = max(0, bisect_left(firsts, key) - 1)
    for first, last, _, file, offset, length, *_ in directory[lo : bisect_right(firsts, key)]:
        if first <= key <= last:
            lines = _lines(read_range(index, file, offset, length))
            keys = [x[0] for x in lines]
            for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                found.append(parse(gzip.decompress(read_range(folder, *x[2:]))))
    return found


def _entries(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                cols = list(zip(*_lines(read_range(folder, file, offset, length)), strict=True))[2:]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "offset", "length"])

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        name, f = None, None
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            rows = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, system.open_input_file(f"{path}/{file}")
                f.seek(offset)
                x = parse(zlib.decompress(f.read(length), 31))
                rows.append(tuple(x[c] for c in names))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_all(spark: SparkSession, folder: str, index: str, directory: DataFrame) -> DataFrame:
    """Every record, through the index: ranges of a file are read in order, a stretch of a file at a time."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = directory.repartition(n, "file", "offset").mapInArrow(_entries(index), "file string, offset long, length long")
    ordered = entries.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_records(folder), READ)


def _place(key: str, page: int | None) -> tuple:
    """Key and page in the order of the index: a null page comes first."""
    return key, page is not None, page or 0


def _files_of(bounds: list[tuple]):
    """Rows (file, key, page_id): the index files that may have a page. ``bounds``: (first place, last place, file), in order."""
    firsts = [b[0] for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), strict=True):
                key = key_of(url)
                place = _place(key, page)
                i = bisect_right(firsts, place) - 1
                while i >= 0 and bounds[i][1] >= place:
                    out.append((bounds[i][2], key, page))
                    i -= 1
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["file", "key", "page_id"])

    return run


def _found(index: str):
    def run(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        """The lines of an index file's wanted pages, in order: the block by bisection of the directory, the line by that of the block, which is held until another is needed."""
        want = sorted({_place(k, p) for k, p in zip(wanted.column("key").to_pylist(), wanted.column("page_id").to_pylist(), strict=True)})
        rows = sorted(blocks.to_pylist(), key=lambda x: (_place(x["first_key"], x["first_page"]), x["offset"]))
        firsts, lasts = [_place(x["first_key"], x["first_page"]) for x in rows], [_place(x["last_key"], x["last_page"]) for x in rows]
        out, held, lines, places = [], -1, [], []
        for place in want:
            for i in range(bisect_left(lasts, place), bisect_right(firsts, place)):  # rows of one page may go over several blocks; the last may hold the next page
                if i != held:
                    held, lines = i, _lines(read_range(index, rows[i]["file"], rows[i]["offset"], rows[i]["length"]))
                    places = [_place(*line[:2]) for line in lines]
                out += [line[2:] for line in lines[bisect_left(places, place) : bisect_right(places, place)]]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

    return run


def read_pages(pages: DataFrame, folder: str, index: str, directory: DataFrame) -> DataFrame:
    """The records of ``pages`` (page_id, url), each found in the index by binary search.

    The driver holds the key range of each index file, of which there are as many as shuffle partitions, and no more.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda k, p: F.struct(k, p)
    rows = directory.groupBy("file").agg(F.min(place("first_key", "first_page")).alias("a"), F.max(place("last_key", "last_page")).alias("b")).collect()
    bounds = sorted((_place(*r.a), _place(*r.b), r.file) for r in rows)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    wanted = src.mapInArrow(_files_of(bounds), "file string, key string, page_id long")
    found = wanted.groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(_found(index), "file string, offset long, length long")
    return found.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_records(folder), READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = new_folder(spark, "warc"), new_folder(spark, "warc-index")
    pages = read(spark, sf_dir, "pages")
    return read_pages(pages, folder, index, build_index(write_archives(pages, folder), index))


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 AND page_id IS NOT NULL GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""
