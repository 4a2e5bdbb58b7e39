"""Readers of raw, clean and feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.schema import CLEAN, RAW, RAW_COLUMNS, RAW_TYPED, SchemaError

POSITION = "source_position"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line of a CSV file, a byte-order mark removed."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise SchemaError(f"{path} has no header")
    return [c.strip('"') for c in first[0][0].lstrip("﻿").rstrip("\r").split(",")]


def require_header(spark: SparkSession, path: str, columns: list[str]) -> None:
    if (found := csv_header(spark, path)) != columns:
        raise SchemaError(f"expected header {columns}, found {found}")


#: Quotes inside a field are doubled, as CSV writers do.
_CSV = {"header": True, "escape": '"'}


def read_raw_csv(spark: SparkSession, path: str, with_position: bool = False) -> DataFrame:
    """The raw log, all strings; missing values are empty strings. A row with more fields than columns fails the read.

    With ``with_position``, the column ``source_position`` orders rows by file and place in it,
    whatever the partitions.
    """
    require_header(spark, path, RAW_COLUMNS)
    df = spark.read.schema(T.StructType([*RAW.fields, T.StructField("__more", T.StringType())])).options(**_CSV, enforceSchema=True).csv(path)
    first = F.when(F.col("__more").isNotNull(), F.raise_error("a row has too many fields").cast("string")).otherwise(F.coalesce("time", F.lit("")))
    rows = [first.alias("time"), *(F.coalesce(c, F.lit("")).alias(c) for c in RAW_COLUMNS[1:])]
    if not with_position:
        return df.select(*rows)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(*rows, place.alias(POSITION))


def read_typed_csv(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The raw log with integer columns; a value that is no integer fails the read. ``source`` is as in ``read_clean``."""
    require_header(spark, path, RAW_COLUMNS)
    df = spark.read.schema(RAW_TYPED).options(**_CSV, enforceSchema=False, mode="FAILFAST").csv(path)
    return df.select("*", F.expr(_SOURCE).alias(source)) if source else df


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """A clean log as CSV, cast to the clean schema; a value of the wrong type fails the read."""
    names = CLEAN.fieldNames()
    require_header(spark, path, names)
    options = {**_CSV, "enforceSchema": False, "mode": "FAILFAST", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    return spark.read.schema(CLEAN).options(**options).csv(path)


#: A column that tells files apart, and a file from what was there under its name before.
_SOURCE = "substring(sha2(concat_ws('|', _metadata.file_path, _metadata.file_size, _metadata.file_modification_time), 256), 1, 16)"


def read_clean(spark: SparkSession, path: str, columns: list[str] | None = None, start=None, end=None, source: str | None = None) -> DataFrame:
    """Clean Parquet with column pruning and a closed time window, both pushed to the scan.

    Of a log with a folder for each day, only the days of the window are listed and read. ``source`` names
    a last column that tells which file a row came from.
    """
    reader = spark.read
    df = reader.parquet(path)
    names = df.columns
    if dict(df.dtypes).get("behavior_date") == "date":  # told from folders: the last column, and not as text
        names = [*(c for c in CLEAN.fieldNames() if c in names), *(c for c in names if c not in CLEAN.fieldNames())]
        kinds = {f.name: f for f in [*df.schema.fields, *CLEAN.fields]}
        df = reader.schema(T.StructType([kinds[c] for c in names])).parquet(path)
    return window(df, start, end).select(*(columns or names), *([F.expr(_SOURCE).alias(source)] if source else []))


def window(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows whose time lies in the closed window; a bound that is None is open. A column of dates is bounded too, for its folders' sake."""
    for bound, within in ((start, lambda a, b: a >= b), (end, lambda a, b: a <= b)):
        if bound is not None:
            time = F.lit(bound).cast("timestamp_ntz")
            df = df.where(within(F.col("time"), time))
            if "behavior_date" in df.columns:
                df = df.where(within(F.col("behavior_date"), time.cast("date").cast("string")))
    return df


def parquet_profile(spark: SparkSession, path: str) -> dict:
    """Column names, types and row count, from the footers."""
    df = spark.read.parquet(path)
    return {"columns": dict(df.dtypes), "rows": df.count()}


def status_passed(spark: SparkSession, path: str) -> bool:
    """True if a status file says PASS, on whatever file system it lies."""
    return not spark.read.text(path).where(F.col("value").contains("STATUS = PASS")).isEmpty()
