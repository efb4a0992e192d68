"""Streams with state of their own by key: conversations that go on over batches, and leases with timers.

Both need the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` (``STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import conversation, leases

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_CARRIED = ("conv_id", "turn", "text", "clean", "reset", "live", "hard", "no_doctor", "exclude", "include")


class Conversations(StatefulProcessor):
    """Carries, per conversation, the fields and whether there is a query yet. Turns of a batch are put in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fields", "asked boolean, " + ", ".join(f"{c} string" for c in conversation.FIELDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names of the interface)
        kept = self.state.get() if self.state.exists() else None
        asked, now = (kept[0], dict(zip(conversation.FIELDS, kept[1:], strict=True))) if kept else (False, {c: conversation.INITIAL.get(c) for c in conversation.FIELDS})
        for r in sorted(rows, key=lambda r: (r.turn, r.text is not None, r.text or "")):
            if r.reset:
                asked, now = False, {c: conversation.INITIAL.get(c) for c in conversation.FIELDS}
            was = asked
            told = r.with_query if asked else r.without_query
            for c in conversation.FIELDS:
                if told[f"set_{c}"] is not None:
                    v = told[f"set_{c}"]["v"]
                    now[c] = conversation.INITIAL[c] if v is None and c in conversation.INITIAL else v
            asked = asked or (r.live and not r.hard)
            yield Row(conv_id=key[0], turn=r.turn, clean=r.clean, reset=r.reset, plain=told["plain"], asked=was, exclude=r.exclude, include=r.include, no_doctor=r.no_doctor, order=r.order, media=r.media, **now)
        self.state.update((asked, *(now[c] for c in conversation.FIELDS)))

    def close(self) -> None:
        pass


_TOLD = "conv_id long, turn long, clean string, reset boolean, plain boolean, asked boolean, exclude boolean, include boolean, no_doctor boolean, order struct<v: string>, media struct<v: string>, " + ", ".join(f"{c} string" for c in conversation.FIELDS)


def conversation_states(turns: DataFrame, known: conversation.Vocabulary = conversation.Vocabulary()) -> DataFrame:
    """``conversation.states`` of a stream whose turns arrive in order: what a turn says is worked out by expressions, the state is carried on."""
    said = conversation.intents(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text"), known)
    told = ["plain", *[f"set_{c}" for c in conversation.FIELDS]]
    for name, asked in (("with_query", True), ("without_query", False)):
        said = conversation.settings(said.withColumn("asked", F.lit(asked))).withColumn(name, F.struct(*told)).drop("asked", *told)
    rows = said.select(*_CARRIED, "order", "media", "with_query", "without_query")
    out = rows.groupBy("conv_id").transformWithState(statefulProcessor=Conversations(), outputStructType=_TOLD, outputMode="Append", timeMode="None")
    return conversation.described(out)


class Leases(StatefulProcessor):
    """Carries the lease of an item; a timer at its end recovers it, should no request come first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "owner string, expires_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.state.get() if self.state.exists() else None
        lease = leases.Lease(*kept) if kept else None
        before = lease
        for lease, e in leases.steps(lease, leases.requests(rows)):
            yield _event(key[0], e)
        if lease != before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if lease is None:
                self.state.clear()
            else:
                self.state.update(tuple(lease))
                self.handle.registerTimer(lease.expires_at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            lease = leases.Lease(*self.state.get())
            self.state.clear()
            yield _event(key[0], (lease.expires_at, "CLAIM_RECOVERED", lease.owner, None))

    def close(self) -> None:
        pass


def _event(item: int, e: tuple) -> Row:
    return Row(item_id=item, at=e[0], event=e[1], owner=e[2], expires_at=e[3])


def lease_history(rows: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``leases.history`` of a stream (item_id, requested_at timestamp, number, kind, owner, seconds): timers go by event time.

    A lease is recovered when the watermark passes its end, or by the first request after it, with the same event either way.
    """
    at = rows.withWatermark("requested_at", delay).withColumn("at", leases.milliseconds("requested_at"))
    return at.groupBy("item_id").transformWithState(statefulProcessor=Leases(), outputStructType=leases.HISTORY, outputMode="Append", timeMode="EventTime")
