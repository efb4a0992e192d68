"""Edge cases of single operators on small rows."""

import fnmatch
import json
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from catalux.functions import details, hashing, text, vectors
from catalux.operators import conversation, dedupe, fulltext, inventory, lifecycle, quality, rules, search, sync

FILE = "file_id long, file_name string, mime_type string, file_extension string, relative_path string, accessibility_status string, size_bytes long, trashed boolean, is_missing boolean, is_folder boolean, raw_type_ok boolean"
JPG = {"file_name": "a.jpg", "mime_type": "image/jpeg", "file_extension": "jpg", "relative_path": "A/B", "accessibility_status": "accessible", "size_bytes": 5, "trashed": False, "is_missing": False, "is_folder": False, "raw_type_ok": True}


def test_rules(spark):
    cases = [
        ({}, "SUPPORTED_FORMAT"), ({"file_extension": " .JPG ", "mime_type": "IMAGE/JPEG "}, "SUPPORTED_FORMAT"), ({"is_folder": True, "accessibility_status": "inaccessible"}, "FOLDER_ITEM"),
        ({"mime_type": "application/vnd.google-apps.folder"}, "FOLDER_ITEM"), ({"accessibility_status": "inaccessible", "file_name": ""}, "INACCESSIBLE"), ({"file_name": " "}, "INVALID_METADATA"), ({"file_name": None}, "INVALID_METADATA"),
        ({"accessibility_status": "maybe"}, "INVALID_METADATA"), ({"accessibility_status": None}, "INVALID_METADATA"), ({"trashed": None}, "INVALID_METADATA"), ({"raw_type_ok": False}, "INVALID_METADATA"), ({"trashed": True, "is_missing": True}, "TRASHED_FILE"),
        ({"is_missing": True}, "MISSING_FILE"), ({"mime_type": "application/vnd.google-apps.shortcut"}, "GOOGLE_DRIVE_SHORTCUT"), ({"mime_type": "application/vnd.google-apps.document"}, "GOOGLE_NATIVE_FILE"), ({"file_name": "~$a.jpg"}, "TEMPORARY_FILE"),
        ({"file_name": "a.CRDOWNLOAD"}, "TEMPORARY_FILE"), ({"file_name": "Thumbs.db"}, "SYSTEM_FILE"), ({"file_name": "._a.jpg"}, "SYSTEM_FILE"), ({"file_name": ".a.jpg"}, "SUPPORTED_FORMAT"), ({"file_name": "Draft-1.JPG"}, "EXCLUDED_FILENAME"),
        ({"relative_path": "x\\\\Private/y"}, "EXCLUDED_PATH"), ({"file_extension": "heic"}, "UNSUPPORTED_EXTENSION"), ({"file_extension": None}, "UNSUPPORTED_EXTENSION"), ({"file_extension": "..jpg"}, "UNSUPPORTED_EXTENSION"), ({"mime_type": None}, "INVALID_METADATA"),
        ({"mime_type": "image/png"}, "UNSUPPORTED_MIME_TYPE"), ({"size_bytes": -1}, "INVALID_SIZE"), ({"size_bytes": None}, "INVALID_SIZE"), ({"size_bytes": 0}, "ZERO_BYTE_FILE"),
    ]
    names = [c.split()[0] for c in FILE.split(", ")]
    rows = [tuple({**JPG, "file_id": i, **c}[n] for n in names) for i, (c, _) in enumerate(cases)]
    out = rules.decide(spark.createDataFrame(rows, FILE), rules.Rules(excluded_names=(" draft-*",), excluded_paths=("X/private/*",))).orderBy("file_id").collect()
    assert [r.reason_code for r in out] == [w for _, w in cases]
    by = {w: r for (_, w), r in zip(cases, out)}
    assert by["SUPPORTED_FORMAT"].decision == "TAKE" and by["FOLDER_ITEM"].decision == "PENDING" and by["ZERO_BYTE_FILE"].media_category == "image" and by["UNSUPPORTED_EXTENSION"].media_category is None
    assert out[25].media_category == "image" and out[5].media_category is None


def test_globs(spark):
    patterns = ["*.jpg", "a?c", "[ab]*", "[!a]b", "x[", "a.b", "*", "[a-c]1", "[]x]y"]
    values = ["a.jpg", "abc", "bz", "cb", "x[", "aXb", "", "b1", "]y", "a\nc", "xy"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for p in patterns:
        assert [r.m for r in df.select(text.matches_any(F.col("v"), (p,)).alias("m")).collect()] == [fnmatch.fnmatchcase(v, p) for v in values], p


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(text.collapse(lit("  a \n b  "), 2)) == "a "
    assert one(text.short_id(lit("x" * 13))) == "x" * 8 + "…" + "x" * 4 and one(text.short_id(lit("x" * 12))) == "x" * 12
    assert one(text.masked_filename(lit("a.b.J_Pg"))) == "Restricted file.jpg" and one(text.masked_filename(lit("none"))) == "Restricted file"
    assert [one(text.format_bytes(lit(n))) for n in (None, 0, 1023, 1024, 1536, 1 << 20, 3 << 29, 1 << 40, 1 << 52)] == ["—", "0 B", "1023 B", "1 KB", "2 KB", "1.0 MB", "1.5 GB", "1.0 TB", "4096.0 TB"]
    assert one(text.folder_id(lit("https://drive.google.com/drive/folders/Ab-1_?x=1"))) == "Ab-1_" and one(text.folder_id(lit("http://drive.google.com/drive/folders/a"))) is None and one(text.folder_id(lit("https://u@drive.google.com/drive/folders/a"))) is None
    assert one(text.redacted(lit("x Password = abc\n y"))) == "x Password=[REDACTED] y"
    assert one(text.safe_stem(lit(" my  file/x..JPG "), lit("jpg"))) == "my-file-x" and one(text.safe_stem(lit("CON.jpg"), lit("jpg"))) == ""
    assert one(text.destination_name(lit("0011aabb-ccdd"), lit(".PDF"))) == "asset__0011aabb.pdf"
    assert tuple(one(text.byte_range(lit("bytes=2-"), lit(10)))) == (2, 9) and tuple(one(text.byte_range(lit("bytes=-3"), lit(10)))) == (7, 9) and one(text.byte_range(lit("bytes=10-"), lit(10))) is None and one(text.byte_range(lit("x"), lit(10))) is None
    assert one(text.boolean(lit(" Yes "))) is True and one(text.boolean(lit("off"))) is False and one(text.boolean(lit("?"))) is None
    assert one(text.trigrams(lit("Ab c"))) == ["  a", " ab", "ab ", "  c", " c "] and one(text.trigram_similarity(lit(None).cast("string"), lit(""))) == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 2.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, None)], "k int, v array<float>")
    got = df.select("k", vectors.valid(F.col("v"), 2).alias("ok"), vectors.cosine(F.col("v"), vectors.literal([3, 4])).alias("c")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False] and got[0].c == pytest.approx(1) and got[2].c is None and got[4].c is None
    mean = {r.k: r.vector for r in vectors.mean_vectors(df.where("k = 1"), "k", "v").collect()}
    assert mean[1] == pytest.approx([1.5 / math.hypot(1.5, 3), 3 / math.hypot(1.5, 3)])


def test_snapshot_edges(spark):
    schema = "file_id string, modified_at string, size_bytes long, mime_type string, checksum string, accessible boolean, is_missing boolean, folder_id string"
    d = spark.createDataFrame([("same", "2024-01-01T00:00:00Z", 1, "m", None, True, None, "f"), ("gone", None, 1, "m", "c", False, None, "f"), ("new", None, 1, None, None, True, None, "f"), ("back", None, 1, "m", "c", True, None, "f"), ("sum", None, 1, "m", "c", True, None, "f")], schema)
    s = spark.createDataFrame([("same", "2024-01-01T02:00:00+02:00", 1, "m", "c", None, False, "f"), ("gone", None, 1, "m", "c", None, False, "f"), ("back", None, 1, "m", "c", None, True, "f"), ("sum", None, 1, "m", "x", None, None, "f"), ("left", None, 1, "m", "c", None, False, "g")], schema)
    want = {"same": "UNCHANGED", "gone": "INACCESSIBLE", "new": "NEW", "back": "CHANGED", "sum": "CHANGED", "left": "REMOVED_FROM_SOURCE"}
    assert {r.file_id: r.classification for r in sync.classify(d, s).collect()} == want
    failed = spark.createDataFrame([("g",)], "folder_id string")
    assert "left" not in {r.file_id for r in sync.classify(d, s, failed).collect()}
    o = spark.createDataFrame([("a", "SKIPPED"), ("a", "UNCHANGED"), ("b", "odd")], "file_id string, outcome string")
    r = sync.reconcile(o, 3).first()
    assert (r.invalid, r.repeated, r.clean) == (1, 1, False) and sync.reconcile(o.limit(1), 1).first().clean


def test_duplicates_without_pairs(spark):
    r = random.Random(1)
    rows = [(i, f"c{r.randrange(6)}" if i % 7 else None, r.randrange(3)) for i in range(60)]
    df = spark.createDataFrame(rows, "file_id long, checksum string, size_bytes long")
    want = {}
    for i, c, n in rows:
        other = [j for j, d, m in rows if d == c and m == n and j != i and c is not None]
        if other:
            want[i] = min(other)
    assert {x.file_id: x.duplicate_of for x in dedupe.exact_duplicates(df).collect()} == want


def test_queue(spark):
    now = F.expr("TIMESTAMP '2024-01-01 12:00:00'")
    schema = "id int, upload_status string, attempts int, claim_owner string, claim_expires_at timestamp, next_retry_at timestamp, last_attempt_at timestamp, created_at timestamp"
    t = lambda h: __import__("datetime").datetime(2024, 1, 1, h)
    q = spark.createDataFrame([(1, "NOT_STARTED", 0, None, None, None, None, t(1)), (2, "QUEUED", 0, None, None, None, None, t(2)), (3, "CLAIMED", 1, "x", t(13), None, None, t(0)), (4, "CLAIMED", 1, "x", t(11), None, None, t(0)), (5, "FAILED_RETRYABLE", 1, None, None, t(13), None, t(0)), (6, "QUEUED", 5, None, None, None, None, t(0))], schema)
    got = lifecycle.claim(q, now, " w ", 10, 60).orderBy("id").collect()
    assert [(r.id, r.previous_status, r.attempts, r.claim_owner) for r in got] == [(1, "NOT_STARTED", 1, "w"), (2, "QUEUED", 1, "w"), (4, "CLAIMED", 2, "w")]
    assert lifecycle.claim(q, now, "w", 1, 60).first().id == 2 and lifecycle.claim(q, now, " ", 1, 60).count() == 0 and lifecycle.claim(q, now, "w", 101, 60).count() == 0
    renewed = {r.id: r.updated for r in lifecycle.renew(q, now, "x", 60).collect()}
    assert renewed == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert {r.id: r.upload_status for r in lifecycle.release(q, now, "x").collect()}[3] == "QUEUED"


def test_inventory_checks(spark):
    schema = "file_id string, name string, size long, modified_time string, accessibility_status string, classification string"
    rows = [("1", "a", 1, "2024-01-01T00:00:00Z", "accessible", "supported_media"), ("", "a", -1, "2024-01-01", "accessible", "inaccessible"), ("2", None, None, None, "x", None)]
    got = [r.e for r in spark.createDataFrame(rows, schema).select(inventory.item_errors().alias("e")).collect()]
    assert got == [[], ["file_id", "size", "modified_time", "accessibility_mismatch"], ["name", "accessibility_status", "classification", "accessibility_mismatch"]]
    edges = spark.createDataFrame([("r", "a", "A"), ("a", "b", "B"), ("b", "a", "again"), ("z", "y", "Y")], "parent string, node string, name string")
    assert {(r.node, r.depth, r.path) for r in inventory.folder_paths(edges, "r").collect()} == {("r", 0, ""), ("a", 1, "A"), ("b", 2, "A/B")}
    m = spark.createDataFrame([("s", "https://drive.google.com/drive/folders/F1", "", "F1"), ("", "x", "yes", ""), ("s", "x", "yes", ""), ("s", "https://drive.google.com/drive/folders/F1", "perhaps", ""), ("s", "https://drive.google.com/drive/folders/F1", "no", "F2")], "source_name string, folder_url string, active string, expected_folder_id string")
    assert [r.reason for r in inventory.onboarding_rows(m).collect()] == [None, "MISSING_SOURCE_NAME", "INVALID_FOLDER_URL", "INVALID_ACTIVE", "FOLDER_ID_MISMATCH"]


def test_search_choice_and_bounds(spark, tmp_path):
    assert search.Query(limit=1000, offset=-5).page == (100, 0) and search.Query(limit=0).page == (1, 0) and search.Query(q="  ").words is None
    assets = spark.createDataFrame([(1, "hair.jpg", "image/jpeg", "jpg", 5, 1), (2, "b.mp4", None, "mp4", 7, None)], "asset_id long, file_name string, mime_type string, file_extension string, size_bytes long, updated_at long")
    index = spark.createDataFrame([(1, "INDEXED", "long hair", "Hair", None, None)], "asset_id long, indexing_status string, searchable_text string, treatment string, subject string, doctor_name string")
    emb = spark.createDataFrame([(1, "m'n", [1.0, 0.0]), (1, "n", [0.0, 1.0]), (2, "m'n", [1.0, 1.0])], "asset_id long, model string, embedding array<float>")
    terms = fulltext.build(index, assets, f"{tmp_path}/index", shards=3)
    text_score = 608  # 0.1 over the limit of the sum of 1/i**2
    v1 = search.search(assets, index, emb, emb, search.Query(q="hairs", semantic=[1.0, 0.0]), terms).collect()
    assert [(r.asset_id, r.match_score, r.text_score, r.total_count) for r in v1] == [(1, 4500 + 122 + 800, text_score, 2), (1, 122 + 800, text_score, 2)]
    v2 = search.search(assets, index, emb, emb, search.Query(visual=[1.0, 0.0], visual_identity={"model": "m'n"}), terms).collect()
    assert [r.asset_id for r in v2] == [1, 2] and v2[0].match_score == 6500
    assert search.hybrid_v1(assets, index, emb, search.Query(), terms).count() == 0
    assert search.hybrid_v2(assets, index, emb, emb, search.Query(q="hair", category="other"), terms).count() == 0
    page = search.search(assets, index, emb, emb, search.Query(sort="largest"), terms).collect()
    assert [(r.asset_id, r.match_score, r.total_count) for r in page] == [(2, None, 2), (1, None, 2)]
    assert [r.asset_id for r in search.search(assets, index, emb, emb, search.Query(name="HAIR"), terms).collect()] == [1]


def test_search_parameters():
    q = search.Query.of({"nlq": " hair ", "page": "3x", "pageSize": "50", "type": "video", "extension": ".M-o.V", "query": "a*(b)", "sort": None})
    assert (q.q, q.page, q.category, q.extension, q.name, q.sort) == ("hair", (50, 100), "video", "mov", "ab", "newest")
    assert search.Query.of({"page": "-2", "pageSize": "7"}).page == (25, 0) and search.Query.of({"nlq": "x" * 999}).q == "x" * 300
    for bad in ({"limit": "3"}, {"category": "song"}, {"sort": "best"}):
        with pytest.raises(ValueError):
            search.Query.of(bad)


def test_quality_and_digest(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert {(r.k, r.rule) for r in quality.violations(df, "k", {"v": F.col("v") == "b"}).collect()} == {(1, "v")}
    a, b = (hashing.table_digest(x, "k", "v").first().digest for x in (df, df.orderBy(F.desc("k"))))
    assert a == b != hashing.table_digest(df.fillna(""), "k", "v").first().digest
    meta = spark.createDataFrame([('{"content_type": "Consultation", "short_caption": " c ", "ai_description": "d", "subject": "Unknown"}',), ("[1]",), ('{"x": 1}',), (None,)], "j string")
    got = quality.structured_metadata(meta, "j", ("Consultation",)).collect()
    assert (got[0].short_caption, got[0].subject, got[0].error) == ("c", None, None) and [r.error for r in got[1:]] == ["NOT_AN_OBJECT", "UNAPPROVED_FIELDS", "NOT_AN_OBJECT"]


def test_conversation_states(spark):
    known = conversation.Vocabulary(doctors={"Dr Hair": ("with dr hair",)}, brands={"Long Hair FUE": ("long hair fue",)})
    said = ["With Dr. Hair", "long hair fue before and after", "videos only, no testimonials", None, "with Dr Hair", "include testimonials", "clear doctor", "Start over.", "woman"]
    turns = spark.createDataFrame([(1, n, t) for n, t in enumerate(said)], "conv_id long, turn long, text string")
    r = {x.turn: x for x in conversation.states(turns, known).collect()}
    assert [r[n].operation for n in range(9)] == ["START_NEW_SEARCH", "REFINE_SEMANTIC_QUERY", "ADD_FILTER", "REFINE_SEMANTIC_QUERY", "ADD_FILTER", "REMOVE_FILTER", "REMOVE_FILTER", "RESET_SEARCH", "START_NEW_SEARCH"]
    assert r[1].treatment == "Long Hair FUE" and r[4].semantic_query == "long hair fue before and after" and r[4].doctor_name == "Dr Hair"
    assert r[2].media_type == "video" and r[2].excluded == "Patient Testimonial" and r[2].labels == "Long Hair FUE|Videos|Dr Hair|Not Patient Testimonial"
    assert r[5].excluded == "" and r[6].doctor_name is None and r[7].effective_query == "" and r[8].effective_query == "woman. Female patient"


def test_state_parameters(spark):
    row = spark.createDataFrame([("a  b", "video", "", None, None, "Other", "x|y", "relevance"), ("", "sound", "t", None, None, None, "", "newest")], ", ".join(f"{c} string" for c in conversation.FIELDS))
    back = row.select(conversation.to_parameters().alias("p")).select("p", *[x.alias(c) for c, x in conversation.from_parameters(F.col("p")).items()]).collect()
    assert back[0].p == {"cs_q": "a  b", "cs_media": "video", "cs_content": "Other", "cs_exclude": "x|y"} and back[0].semantic_query == "a b" and back[0].sort == "relevance"
    assert back[1].media_type is None and back[1].treatment == "t" and back[1].sort == "newest" and back[1].semantic_query == ""



def test_details_lose_their_secrets_and_stay_json(spark):
    texts = [
        '{"error":"password: abc","file":"f1","n":3}', '{"password":"abc"}', '{"a":{"b":{"c":{"d":{"e":{"password":"x"}}}}}}', "password: abc and more", '{"broken', None, '{"x":"%s"}' % ("y" * 900), '{"q":"say \\"hi\\" \\u00e9 \\\\ /"}', "{}",
        '{"text":"{\\"password\\":\\"x\\",\\"k\\":1}"}', "[1]", '{"Signed_URL":{"a":1},"l":[[{"PASSWORD":1}],null,2.5]}',
    ]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "details string").select(details.sanitized("details").alias("d")).collect()]
    assert json.loads(got[0]) == {"error": "password=[REDACTED]", "file": "f1", "n": "3"} and got[1] == "{}"
    assert json.loads(got[2]) == {"a": {"b": {"c": {"d": {"e": "[REDACTED]"}}}}}
    assert got[3] == "password=[REDACTED] and more" and got[4] == '{"broken' and got[5] is None
    assert json.loads(got[6]) == {"x": "y" * 500} and json.loads(got[7]) == {"q": 'say "hi" é \\ /'} and got[8] == "{}"
    assert json.loads(got[9]) == {"text": {"k": "1"}} and got[10] == "[1]" and json.loads(got[11]) == {"l": [[{}], None, "2.5"]}


def test_stems_are_portable_and_composed(spark):
    names = {
        " my  file/x..JPG ": "my-file-x", "CON.jpg": "", "a_b.c.jpg": "a_b.c", "_a_.jpg": "a", "a-_b.jpg": "a-b", "a\tb\\c\x01d.JPG  ": "a-b-c-d", "..": "", "é.jpg": unicodedata.normalize("NFC", "é"), "e\u0301\u0323x": unicodedata.normalize("NFC", "e\u0301\u0323x"),
        "\u1112\u1161\u11ab": "한", "a\u00a0b\u2003.jpg": "a-b", "lpt1": "", "lpt10": "lpt10", "x.jpg.jpg": "x.jpg", "x(1) [2].jpg": "x(1)-[2]",
    }
    rows = spark.createDataFrame([(k,) for k in names], "name string").select("name", text.safe_stem("name", F.lit("jpg")).alias("s")).collect()
    assert {r.name: r.s for r in rows} == names
    points = [chr(i) for i in range(0xA0, 0x3000) if not 0xD800 <= i < 0xE000] + [unicodedata.normalize("NFD", chr(i)) for i in range(0xA0, 0x3000)]
    got = spark.createDataFrame(list(enumerate(points)), "i long, s string").select("i", text.nfc("s").alias("s")).collect()
    assert all(r.s == unicodedata.normalize("NFC", points[r.i]) for r in got)
    assert spark.createDataFrame([(None,)], "name string").select(text.safe_stem("name", F.lit("jpg")).alias("s")).first().s is None
