"""Counts and streaks along ordered sequences of any length, without a sequence in one task.

Rows are put in order by range partitions, so a long sequence lies in several. A *block* is the part of a sequence in one partition. Its
summary (rows, sums, number of the last row without a flag) is associative: sums add up, and of the last rows the latest counts. A
prefix over the summaries, at most one a sequence and partition, tells each block what came before; the rest is a window within blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from .lifecycle import stop_reason_of


def running(df: DataFrame, run: str, order: str, sums: tuple[str, ...] = (), streaks: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with n_so_far, ``<c>_so_far`` of each flag in ``sums`` and ``<c>_streak`` (how many rows in a row, this one included) of each in ``streaks``.

    ``order`` is unique within a run. A null flag is false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = df.repartitionByRange(run, order).sortWithinPartitions(run, order).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33))
    rows = storage.materialize(rows, "in-order")
    inside = Window.partitionBy("_part", run).orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_i", F.row_number().over(inside))
    rows = rows.withColumns({**{f"_s_{c}": F.sum(flag(c).cast("long")).over(so_far) for c in sums}, **{f"_l_{c}": F.max(F.when(~flag(c), F.col("_i"))).over(so_far) for c in streaks}})
    blocks = rows.groupBy("_part", run).agg(F.max("_i").alias("_n"), *[F.max(f"_s_{c}").alias(f"_t_{c}") for c in sums], *[F.max(f"_l_{c}").alias(f"_e_{c}") for c in streaks])
    earlier = Window.partitionBy(run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    blocks = blocks.withColumns({**{f"_b_{c}": F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)) for c in sums}, **{f"_z_{c}": F.coalesce(F.max(F.col("_before") + F.col(f"_e_{c}")).over(earlier), F.lit(0)) for c in streaks}})
    kept = blocks.select("_part", F.col(run).alias("_run"), "_before", *[f"_b_{c}" for c in sums], *[f"_z_{c}" for c in streaks])
    out = rows.withColumnRenamed("_part", "_p").join(kept, (F.col("_p") == F.col("_part")) & F.col(run).eqNullSafe(F.col("_run")))
    now = F.col("_before") + F.col("_i")
    columns = {"n_so_far": now, **{f"{c}_so_far": F.col(f"_b_{c}") + F.col(f"_s_{c}") for c in sums}, **{f"{c}_streak": now - F.coalesce(F.col("_before") + F.col(f"_l_{c}"), F.col(f"_z_{c}")) for c in streaks}}
    return out.withColumns(columns).select(*df.columns, *columns)


def stop_conditions(results: DataFrame, run: str, order: str) -> DataFrame:
    """``lifecycle.stop_conditions`` for runs of any length."""
    df = running(results, run, order, ("severe",), ("mismatch", "exhausted"))
    df = df.withColumnsRenamed({"n_so_far": "attempted", "mismatch_streak": "mismatches", "exhausted_streak": "exhaustions"})
    return df.withColumn("stop_reason", stop_reason_of())
