"""What a catalogue must hold against what it holds: findings with advice, and a verdict after them.

A part compares the expected objects of one category with the actual ones by key. An object without an actual row is MISSING, one with
a field that breaks its rule is a MISMATCH, any other gives no finding. Keys of the actual rows should be unique (``repeated`` finds
those that are not): an object meets each of its rows. A null key meets none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage

FINDING = ("category", "object_name", "expected", "actual", "status", "recommendation")
#: Rules of fields: the same value (null is a value); matches a pattern in the expected row, whole, and null where that is null; true; not blank.
SAME, PATTERN, TRUE, GIVEN = "same", "pattern", "true", "given"


def _broken(field: str, rule: str) -> Column:
    e, a = F.col(f"e_{field}"), F.col(f"a_{field}")
    if rule == SAME:
        return ~e.eqNullSafe(a)
    if rule == PATTERN:
        text = F.coalesce(a.cast("string"), F.lit(""))
        return F.when(e.isNull(), a.isNotNull()).otherwise(~F.rlike(text, F.concat(F.lit("^(?:"), e, F.lit(")$"))))
    if rule == TRUE:
        return ~F.coalesce(a, F.lit(False))
    return F.coalesce(F.trim(a.cast("string")), F.lit("")) == ""


def _wanted(field: str, rule: str) -> Column:
    value = F.coalesce(F.col(f"e_{field}").cast("string"), F.lit("NULL")) if rule in (SAME, PATTERN) else F.lit(rule)
    return F.concat(F.lit(f"{field}~" if rule == PATTERN else f"{field}="), value)


def findings(category: str, expected: DataFrame, actual: DataFrame, keys: tuple[str, ...], rules: dict[str, str], advice: str) -> DataFrame:
    """Rows of ``FINDING``. ``rules``: field to rule; without any, only presence counts. Names of objects are their keys, joined by dots."""
    own = [f for f, r in rules.items() if r in (SAME, PATTERN)]
    e = expected.select(*keys, *[F.col(f).alias(f"e_{f}") for f in own])
    a = actual.select(*keys, *[F.col(f).alias(f"a_{f}") for f in rules], F.lit(True).alias("_there"))
    broken = reduce(lambda x, y: x | y, [_broken(f, r) for f, r in rules.items()], F.lit(False))
    status = F.when(F.col("_there").isNull(), "MISSING").when(broken, "MISMATCH")
    have = F.concat_ws("; ", *[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f"a_{f}").cast("string"), F.lit("NULL"))) for f in rules])
    row = e.join(a, list(keys), "left").withColumn("status", status).where("status is not null")
    name = F.concat_ws(".", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    return row.select(
        F.lit(category).alias("category"), name.alias("object_name"), (F.concat_ws("; ", *[_wanted(f, r) for f, r in rules.items()]) if rules else F.lit("present")).alias("expected"),
        F.when(F.col("_there").isNull(), "absent").otherwise(have).alias("actual"), "status", F.lit(advice).alias("recommendation"),
    )


def repeated(category: str, rows: DataFrame, key: str, advice: str) -> DataFrame:
    """A finding for each key (not null) of several rows; counted before the shuffle."""
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit(category).alias("category"), F.concat(F.lit(f"{key}="), F.col(key).cast("string")).alias("object_name"), F.lit("exactly 1 row").alias("expected"), F.col("n").cast("string").alias("actual"), F.lit("MISMATCH").alias("status"), F.lit(advice).alias("recommendation"))


def report(*parts: DataFrame) -> DataFrame:
    """All findings and a row OVERALL; ``at`` is 0 for findings and 1 for that row, to sort by. Findings are stored, so each part runs once."""
    found = storage.materialize(reduce(DataFrame.unionByName, parts), "findings")
    n = found.agg(F.count("*").alias("n"))
    bad = F.col("n") > 0
    verdict = n.select(
        F.lit("OVERALL").alias("category"), F.lit("catalogue").alias("object_name"), F.lit("all that is required is there").alias("expected"), F.when(bad, F.concat(F.col("n").cast("string"), F.lit(" issue(s)"))).otherwise("complete").alias("actual"),
        F.when(bad, "MISMATCH").otherwise("PASS").alias("status"), F.when(bad, "Resolve every finding, then check again.").otherwise("No action required.").alias("recommendation"), F.lit(1).alias("at"),
    )
    return found.withColumn("at", F.lit(0)).unionByName(verdict)
