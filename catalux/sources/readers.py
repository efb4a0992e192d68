"""Readers: explicit schemas, rejected rows kept apart, no inference."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..operators.inventory import onboarding_rows
from ..schemas import INVENTORY_ITEM, INVENTORY_REPORT, ONBOARDING_ROW


def inventory_json(spark: SparkSession, path: str, root_id: str | None = None) -> DataFrame:
    """Reports (one JSON document a file) with ``root_matches``; malformed files have a null summary and the text in _corrupt_record."""
    schema = T.StructType([*INVENTORY_REPORT.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.withColumn("root_matches", F.lit(True) if root_id is None else F.col("root.file_id").eqNullSafe(F.lit(root_id)))


def inventory_items(report: DataFrame) -> DataFrame:
    """Items of a report with their position."""
    return report.select(F.posexplode("items").alias("position", "i")).select("position", "i.*")


def inventory_errors(report: DataFrame) -> DataFrame:
    """Events of a report's scan errors."""
    e = report.select(F.explode("errors").alias("e"))
    return e.select(F.col("e.item_id").alias("item_id"), F.lit("SCAN_ERROR").alias("event_type"), F.lit("ERROR").alias("event_status"), F.to_json(F.col("e")).alias("details"))


def inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Items of a CSV whose header must be that of the schema."""
    return spark.read.schema(INVENTORY_ITEM).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def onboarding_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest with folder_id, is_active and reason (null: accepted); columns are found by the header's names."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return onboarding_rows(df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast("string").alias(f.name) for f in ONBOARDING_ROW]))


#: Columns that a manifest of source folders must and may have (fixed values).
REQUIRED = ("source_name", "account_name", "folder_url", "notes", "active")
OPTIONAL = ("expected_folder_id", "clinical_content", "processing_enabled")


def numbered_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The records of CSV files with a header, as text, with file and ``row_number`` from 2 on in each file.

    A file may be split: records are counted by split, and a split begins where the counts of those before it end. Within a split a
    record's number follows from its id in the task. Records over several lines need ``multi_line``, which doesn't split files.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line).csv(path)
    names = [c.removeprefix("\ufeff") for c in df.columns]
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)], F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    df = storage.materialize(df, "numbered")
    splits = df.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return df.join(splits, ["file", "_split"]).withColumn("row_number", F.col("_before") + F.col("_id") - F.col("_first") + 2).select("file", "row_number", *names)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Numbered rows of a manifest with folder_id, is_active and reason (null: accepted).

    Missing or unknown columns refuse the whole file. Of the acceptable rows of one folder the first is accepted, the others are
    rejected as duplicates.
    """
    df = numbered_csv(spark, path)
    columns = set(df.columns) - {"file", "row_number"}
    if missing := set(REQUIRED) - columns:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    if unknown := columns - {*REQUIRED, *OPTIONAL}:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    rows = onboarding_rows(df)
    first = rows.where("reason is null").groupBy("folder_id").agg(F.min(F.struct("file", "row_number")).alias("_first"))
    later = F.col("reason").isNull() & (F.struct("file", "row_number") != F.col("_first"))
    return rows.join(first, "folder_id", "left").withColumn("reason", F.when(F.coalesce(later, F.lit(False)), "DUPLICATE_FOLDER_ID").otherwise(F.col("reason"))).drop("_first")


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, ties by all columns; rows without a key are left out."""
    w = Window.partitionBy(key).orderBy(*order, *[c for c in df.columns if c not in order])
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bytes_of(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows: path, length, content and its SHA-256."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", "modificationTime", "content", F.sha2("content", 256).alias("content_hash"))


def schema_mismatches(df: DataFrame, schema: T.StructType) -> list[str]:
    """Names whose type differs from ``schema`` or that it or the frame lacks; reads no rows."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in schema}
    return sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))


def latest_run(runs: DataFrame, fingerprint: str, metadata: str = "metadata") -> DataFrame:
    """The latest run whose metadata has a report fingerprint."""
    return runs.where(F.get_json_object(metadata, "$.report_sha256") == fingerprint).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()).limit(1)


_MARK = "version string, folder string, at timestamp"


def versions(spark: SparkSession, folder: str) -> set[str]:
    """Names of the published versions: one marker each. Empty where nothing was published."""
    try:
        marks = spark.read.schema(_MARK).json(f"{folder}/_published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {r.version for r in marks.select("version").distinct().collect()}


def published(spark: SparkSession, folder: str, table: str = "table", version: str | None = None, kind: str = "parquet") -> DataFrame:
    """A table of the latest published version (of that name, if given); what has no marker is not seen."""
    marks = spark.read.schema(_MARK).json(f"{folder}/_published")
    last = marks.where(F.lit(version is None) | (F.col("version") == version)).orderBy(F.col("at").desc(), F.col("folder").desc()).first()
    if last is None:
        raise ValueError(f"no published version in {folder}")
    return spark.read.format(kind).load(f"{folder}/{last.folder}/{table}")
