"""Streams in several batches against the batch operators and a rule written anew."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from catalux.operators import conversation, leases
from catalux.streaming import incremental, stateful

KNOWN = conversation.Vocabulary(doctors={"Dr Hair": ("dr hair", "hair")}, brands={"Brandex": ("brandex",)})
SAID = ["hair transplant results", "only videos", "newest", "Dr Hair", "without doctor", "no testimonials", "include testimonials", "start over", "", None, "female patient", "brandex", "consultation fue", "oldest", "photos only", "all media", "testimonials of men"]


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(stateful.STORE[0])
    spark.conf.set(*stateful.STORE)
    yield spark
    spark.conf.set(stateful.STORE[0], before)


def streamed(spark, batches, schema, plan, folder):
    """The plan's rows, each batch in a run of its own."""
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        stream = plan(incremental.arrived(spark, f"{folder}/in", spark.createDataFrame([], schema).schema))
        incremental.append_available(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_conversations_go_on_over_batches(rocks, tmp_path):
    r = random.Random(2)
    turns = [(c, t, r.choice(SAID)) for c in range(6) for t in range(12)] + [(7, 0, "b"), (7, 0, "a only videos"), (7, 0, None)]
    schema = "conv_id long, turn long, text string"
    cuts = [[x for x in turns if lo <= x[1] < hi] for lo, hi in ((0, 4), (4, 5), (5, 12))]
    got = streamed(rocks, cuts, schema, lambda s: stateful.conversation_states(s, KNOWN), tmp_path)
    want = conversation.states(rocks.createDataFrame(turns, schema), KNOWN)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


START = datetime(2024, 1, 1, tzinfo=UTC)


def plain(rows, until):
    """Per item: a clock that goes from request to request."""
    out = []
    for item in {r[0] for r in rows}:
        owner = end = None
        for _, at, _, kind, who, seconds in sorted((r for r in rows if r[0] == item), key=lambda r: (r[1], r[2])):
            ms = int(at.timestamp() * 1000)
            if owner and end <= ms:
                out.append((item, end, "CLAIM_RECOVERED", owner, None))
                owner = end = None
            if kind == "CLAIM" and not owner:
                owner, end = who, ms + seconds * 1000
                out.append((item, ms, "UPLOAD_CLAIMED", who, end))
            elif kind == "RENEW" and owner == who:
                end = ms + seconds * 1000
                out.append((item, ms, "CLAIM_RENEWED", who, end))
            elif kind == "RELEASE" and owner == who:
                owner = end = None
                out.append((item, ms, "CLAIM_RELEASED", who, None))
            else:
                out.append((item, ms, "CLAIM_REFUSED", who, end))
        if owner and end <= until:
            out.append((item, end, "CLAIM_RECOVERED", owner, None))
    return sorted(map(repr, out))


def test_leases_run_out_by_timers(rocks, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(5), START + timedelta(seconds=s), n, r.choice(["CLAIM", "CLAIM", "RENEW", "RELEASE"]), r.choice("ab"), r.choice([30, 60, 600])) for n, s in enumerate(sorted(r.randrange(4000) for _ in range(120)))]
    rows += [(9, START, 500, "CLAIM", "a", 60), (8, START + timedelta(seconds=5000), 501, "CLAIM", "a", 60), (8, START + timedelta(seconds=9000), 502, "RENEW", "a", 60)]
    schema = "item_id long, requested_at timestamp, number long, kind string, owner string, seconds int"
    cuts = [[x for x in rows if lo <= (x[1] - START).seconds < hi] for lo, hi in ((0, 1500), (1500, 1600), (1600, 6000), (6000, 99999))]
    cuts.append([(10, START + timedelta(seconds=9001), 503, "RELEASE", "z", 1)])  # the watermark of the batch before is in force
    rows += cuts[-1]
    until = int((START + timedelta(seconds=9000)).timestamp() * 1000)
    want = plain(rows, until)
    table = rocks.createDataFrame(rows, schema).withColumn("at", leases.milliseconds("requested_at"))
    assert sorted(repr(tuple(x)) for x in leases.history(table.repartition(3), until).collect()) == want
    got = streamed(rocks, cuts, schema, stateful.lease_history, tmp_path)
    assert sorted(repr(tuple(x)) for x in got.select("item_id", "at", "event", "owner", "expires_at").collect()) == want


def test_no_requests(spark):
    none = spark.createDataFrame([], "item_id long, at long, number long, kind string, owner string, seconds int")
    assert leases.history(none, 0).collect() == []
