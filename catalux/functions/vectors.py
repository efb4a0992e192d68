"""Vectors as arrays of numbers, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or zero or their lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def valid(a: Column, dimension: int) -> Column:
    """The exact length, and every element finite."""
    return F.coalesce((F.size(a) == dimension) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def mean_by(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, mean): means by position, which combine before the shuffle; no vector list is gathered."""
    return df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): mean vector of each key, scaled to length one."""
    m = mean_by(df, key, vector).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("v"))
    return m.select(key, normalized(F.transform("v", lambda p: p["mean"])).alias("vector"))
