"""Data-quality checks that return their violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of each rule that does not hold; a null condition holds, as in a CHECK constraint."""
    broken = F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def expected_vs_actual(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) per expected row: OK, MISSING or DIFFERENT, and a last row OVERALL."""
    a = actual.select(key, F.col(value).alias("found"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "MISSING").when(~F.col(value).eqNullSafe(F.col("found")), "DIFFERENT").otherwise("OK")
    rows = expected.join(a, key, "left").select(F.col(key).cast("string").alias(key), status.alias("status"))
    return rows.unionByName(rows.agg(F.lit("OVERALL").alias(key), F.when(F.count_if(F.col("status") != "OK") == 0, "OK").otherwise("FAILED").alias("status")))


def embedding_integrity(embeddings: DataFrame, eligible: DataFrame, dimension: int, identity: list[str]) -> DataFrame:
    """One row: wrong dimensions or values, vectors whose similarity to themselves isn't 1, repeated identities, eligible assets without a vector."""
    self_cosine = vectors.cosine(F.col("embedding"), F.col("embedding"))
    a = embeddings.agg(F.count("*").alias("vectors"), F.count_if(~vectors.valid(F.col("embedding"), dimension)).alias("wrong_vector"), F.count_if(F.coalesce(F.abs(self_cosine - 1) > 1e-5, F.lit(True))).alias("wrong_norm"))
    repeated = embeddings.groupBy("asset_id", *identity).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated"))
    missing = eligible.join(embeddings, "asset_id", "left_anti").agg(F.count("*").alias("missing"))
    return a.crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(missing))  # one row each


def structured_metadata(df: DataFrame, c: str, content_types: tuple[str, ...], caption: int = 160, description: int = 2000) -> DataFrame:
    """A JSON answer as columns with ``error``: fields outside the contract, no object, or a missing or too long required text."""
    fields = ("content_type", "treatment", "subject", "doctor_name", "short_caption", "ai_description")
    keys = F.json_object_keys(c)
    get = lambda n: F.trim(F.get_json_object(c, f"$.{n}"))
    clean = lambda n: F.when((get(n) != "") & ~F.lower(get(n)).isin("unknown", "n/a", "not visible"), get(n))
    out = df.withColumns({n: clean(n) for n in fields[1:]}).withColumn("content_type", F.coalesce(F.when(F.get_json_object(c, "$.content_type").isin(*content_types), F.get_json_object(c, "$.content_type")), F.lit("Other")))
    error = F.when(keys.isNull(), "NOT_AN_OBJECT").when(F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0, "UNAPPROVED_FIELDS")
    for n, most in (("short_caption", caption), ("ai_description", description)):
        error = error.when(F.col(n).isNull(), f"{n.upper()}_MISSING").when(F.char_length(n) > most, f"{n.upper()}_TOO_LONG")
    return out.withColumn("error", error)
