"""Leases of work items as a history: claims, renewals and releases in order of time, and what each of them did.

``steps`` is the rule, for one item: a claim is granted unless a lease is running, only its owner renews or releases a running
lease, and a lease that ran out is recovered at the time it ended. ``history`` applies it to a table, ``streaming.stateful`` to a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIM, RENEW, RELEASE = "CLAIM", "RENEW", "RELEASE"
#: at: milliseconds of the time that counts; ``expires_at`` where a lease runs afterwards.
HISTORY = "item_id long, at long, event string, owner string, expires_at long"


class Lease(NamedTuple):
    owner: str
    expires_at: int


class Request(NamedTuple):
    at: int
    number: int
    kind: str
    owner: str
    seconds: int


def steps(lease: Lease | None, requests: Iterable[Request]) -> Iterator[tuple[Lease | None, tuple[int, str, str, int | None] | None]]:
    """The lease after each event, and the event (at, name, owner, expires_at): one or two a request."""
    for r in requests:
        if lease is not None and lease.expires_at <= r.at:
            lost, lease = lease, None
            yield None, (lost.expires_at, "CLAIM_RECOVERED", lost.owner, None)
        mine = lease is not None and lease.owner == r.owner
        if (r.kind == CLAIM and lease is None) or (r.kind == RENEW and mine):
            lease = Lease(r.owner, r.at + 1000 * r.seconds)
            yield lease, (r.at, "UPLOAD_CLAIMED" if r.kind == CLAIM else "CLAIM_RENEWED", r.owner, lease.expires_at)
        elif r.kind == RELEASE and mine:
            lease = None
            yield None, (r.at, "CLAIM_RELEASED", r.owner, None)
        else:
            yield lease, (r.at, "CLAIM_REFUSED", r.owner, lease.expires_at if lease else None)


def requests(rows: Iterable) -> list[Request]:
    """Rows of item_id, at (milliseconds), number, kind, owner, seconds, in order of time and then number."""
    return sorted(Request(r.at, r.number, r.kind, r.owner, r.seconds) for r in rows)


def history(rows: DataFrame, until: int) -> DataFrame:
    """item_id, at, event, owner, expires_at of a table of requests; leases that end by ``until`` (milliseconds) are recovered.

    An item's requests are one sequence, so they are one task's; it reads them in batches of sorted rows and holds one lease.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, lease = None, None

        def ended() -> list[tuple]:
            return [(item, lease.expires_at, "CLAIM_RECOVERED", lease.owner, None)] if lease is not None and lease.expires_at <= until else []

        columns = ["item_id", "at", "event", "owner", "expires_at"]
        for b in batches:
            out: list[tuple] = []
            for r in b.itertuples(index=False):
                if r.item_id != item:
                    out += ended()
                    item, lease = r.item_id, None
                for lease, e in steps(lease, [Request(r.at, r.number, r.kind, r.owner, r.seconds)]):
                    out.append((item, *e))
            yield pd.DataFrame(out, columns=columns).astype({"expires_at": "Int64"})
        if last := ended():
            yield pd.DataFrame(last, columns=columns).astype({"expires_at": "Int64"})

    ordered = rows.select("item_id", "at", "number", "kind", "owner", "seconds").repartition("item_id").sortWithinPartitions("item_id", "at", "number")
    return ordered.mapInPandas(run, HISTORY)


def milliseconds(c: str) -> Column:
    return F.unix_millis(c)
