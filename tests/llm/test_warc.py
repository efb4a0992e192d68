"""WARC: exact round trip, revisits, look-up through the index."""

import gzip
import hashlib

import pyarrow as pa

from catalux.llm import warc


def pages():
    big = "<html>é" + "x" * 200
    rows = [(i, f"http://www.Host{i % 7}.example.com/p/{i}?q=é {i}", f"<p>{i}</p>" * (i % 40)) for i in range(150)]
    return rows + [(200, "https://a.example.org/x", big), (199, "https://b.example.org/y", big), (201, None, big), (202, "http://[bad", None), (203, "x\r\ny", ""), (None, "http://c.example.org", big), (199, "https://b.example.org/y", big), (210, "http://s.example.org/", "s"), (211, "http://s.example.org/", "s")]


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, digest int").repartition(3)
    folder, index = warc.new_folder(spark, "t"), warc.new_folder(spark, "i")
    directory = warc.build_index(warc.write_archives(df, folder), index, lines=16)
    got = sorted((tuple(r) for r in warc.read_all(spark, folder, index, directory).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first[h or ""] if i is not None and len(b) >= 100 and i > first[h or ""] else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)
    assert sorted((tuple(r) for r in warc.read_pages(df, folder, index, directory).collect()), key=str) == got
    some = df.where("page_id % 3 = 0 or page_id is null")
    assert sorted((tuple(r) for r in warc.read_pages(some, folder, index, directory).collect()), key=str) == [r for r in got if r[0] is None or r[0] % 3 == 0]
    blocks = sorted((tuple(r) for r in directory.collect()), key=str)
    assert sum(r[2] for r in blocks) == len(rows)
    index_of = {r[3]: r for r in blocks}
    assert index_of
    for i, url, h in rows[:40] + rows[150:152]:
        hits = lookup_both(folder, index, blocks, url)
        assert any(x["page_id"] == i and (x["record_type"] == "revisit" or x["payload"] == (h or "").encode()) for x in hits)
    assert lookup_both(folder, index, blocks, "http://nowhere.example.net/") == []


def lookup_both(folder, index, blocks, url):
    return warc.lookup(folder, blocks, url, index)


def test_keys_and_records():
    assert warc.key_of("http://www.Example.com:80/A?B#c") == "com,example)/a?b"
    assert warc.key_of(None) == "-" and warc.key_of("http://x.org:8080") == "org,x:8080)/"
    x = warc.parse(gzip.decompress(gzip.compress(warc.record(5, "http://a/é", b"\r\n\r\nhi", None))))
    assert x["page_id"] == 5 and x["payload"] == b"\r\n\r\nhi"


def test_empty(spark):
    folder, index = warc.new_folder(spark, "t"), warc.new_folder(spark, "i")
    df = spark.createDataFrame([], "page_id long, url string, html string")
    directory = warc.build_index(warc.write_archives(df, folder), index)
    assert warc.read_all(spark, folder, index, directory).count() == 0 and warc.read_pages(df, folder, index, directory).count() == 0


def test_search_reads_the_blocks_it_needs_once(spark, monkeypatch):
    """Many rows of one page go over several blocks; other blocks stay unread."""
    rows = [(i, f"http://h/{i:04d}", "p") for i in range(100)] + [(50, "http://h/0050", "p")] * 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder, index = warc.new_folder(spark, "t"), warc.new_folder(spark, "i")
    directory = warc.build_index(warc.write_archives(df, folder), index, lines=8)
    file = directory.where("first_page <= 50 and last_page >= 50").first().file
    blocks = directory.where(directory.file == file).toArrow()
    want = [(r.key, r.page_id) for r in spark.createDataFrame([(warc.key_of(u), i) for i, u, _ in rows if i in (50, 51)], "key string, page_id long").distinct().collect()]
    wanted = pa.table({"key": [k for k, _ in want], "page_id": pa.array([p for _, p in want], pa.int64())})
    there = [line for b in blocks.to_pylist() for line in warc._lines(warc.read_range(index, b["file"], b["offset"], b["length"])) if line[1] in (50, 51)]
    read, plain = [], warc.read_range
    monkeypatch.setattr(warc, "read_range", lambda f, n, at, size: read.append(at) or plain(f, n, at, size))
    found = warc._found(index)(wanted, blocks)
    assert sorted(found.to_pylist(), key=lambda x: x["offset"]) == [dict(zip(("file", "offset", "length"), x[2:], strict=True)) for x in sorted(there, key=lambda x: x[3])]
    assert len(there) > 8 and len(read) == len(set(read)) < blocks.num_rows
    assert warc._found(index)(wanted.slice(0, 0), blocks).num_rows == 0


def test_copies_of_one_payload_meet_in_parts(spark):
    df = spark.createDataFrame([(i, b"d" if i % 3 else bytes([i])) for i in range(60)] + [(None, b"d"), (1, b"d")], "page_id long, digest binary")
    assert sorted(tuple(r)[::2] for r in warc.revisits(df).collect()) == [(i, 1) for i in range(2, 60) if i % 3]
