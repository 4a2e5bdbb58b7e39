"""Schemas and fixed dictionaries of the behaviour log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column order of raw and clean tables, behaviour codes and names.
RAW_COLUMNS = ["time", "user_id", "item_id", "item_category", "behavior_type"]
CLEAN_COLUMNS = [
    "time",
    "user_id",
    "item_id",
    "category_id",
    "behavior_type",
    "behavior_name",
    "behavior_date",
    "behavior_hour",
    "weekday",
]
BEHAVIORS = {1: "pv", 2: "fav", 3: "cart", 4: "buy"}
DEFAULT_BURST = 60

RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
RAW_TYPED = T.StructType([T.StructField("time", T.StringType()), *(T.StructField(c, T.LongType()) for c in RAW_COLUMNS[1:])])
CLEAN = T.StructType(
    [
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("behavior_type", T.IntegerType()),
        T.StructField("behavior_name", T.StringType()),
        T.StructField("behavior_date", T.StringType()),
        T.StructField("behavior_hour", T.IntegerType()),
        T.StructField("weekday", T.IntegerType()),
    ]
)


class SchemaError(ValueError):
    """A table does not have the columns that its contract names."""


def require_columns(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """``df`` if it has ``columns``; with ``exact``, these alone and in this order."""
    if exact and df.columns != columns:
        raise SchemaError(f"expected columns {columns}, found {df.columns}")
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaError(f"missing columns {missing}")
    return df


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` if names, order and types agree with ``schema``; nullability is not compared."""
    have, want = ([(f.name, f.dataType) for f in s.fields] for s in (df.schema, schema))
    if have != want:
        raise SchemaError(f"expected {want}, found {have}")
    return df
