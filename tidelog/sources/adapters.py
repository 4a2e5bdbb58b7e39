"""Mappings of other tables to the behaviour log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.cleaning import analyse, clean

#: Observation window of the mapped events and the moment that recency counts to.
WINDOW_START, WINDOW_END, REFERENCE = "2024-01-01 00:00:00", "2024-01-30 23:00:00", "2024-01-31 00:00:00"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a raw log of strings, with ``event_id`` as the position in the source."""
    item = F.regexp_extract("props", "[0-9]+", 0)
    code = (
        F.when(F.col("event_type") == "view", "1")
        .when(F.col("event_type") == "click", "2")
        .when(F.col("event_type") == "signup", "3")
        .when(F.col("event_type") == "purchase", "4")
        .otherwise("9")
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.substring(F.col("ts").cast("timestamp_ntz").cast("string"), 1, 13).alias("time"),
        F.col("user_id").cast("string").alias("user_id"),
        item.alias("item_id"),
        (1 + (item.cast("long") + F.col("event_id") % 3) % 10).cast("string").alias("item_category"),
        code.alias("behavior_type"),
    )


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log with blanks, padding and broken times at fixed places."""
    n = F.col("event_id")
    return raw_events(spark, sf_dir).withColumns(
        {
            "item_id": F.when(n % 97 == 0, "").otherwise(F.col("item_id")),
            "user_id": F.when(n % 89 == 0, F.concat(F.lit("  "), "user_id", F.lit(" "))).otherwise(F.col("user_id")),
            "time": F.when(n % 83 == 0, "not-a-time").otherwise(F.col("time")),
        }
    )


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean log of ``events``, with ``event_id``."""
    return clean(analyse(raw_events(spark, sf_dir)), keep=("event_id",))


def clean_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a clean log: a larger volume with a 24-hour spread and two joins."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = (
        read("lineitem")
        .join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    code = (1 + F.col("l_linenumber") % 4).cast("int")
    time = F.expr("timestampadd(HOUR, cast(l_orderkey % 24 AS int), cast(l_shipdate AS timestamp_ntz))")
    return rows.select(
        time.alias("time"),
        (F.col("o_custkey") + 1).alias("user_id"),
        (F.col("l_partkey") + 1).alias("item_id"),
        F.col("p_size").cast("long").alias("category_id"),
        code.alias("behavior_type"),
    ).select(
        "*",
        F.element_at(F.array(*map(F.lit, ("pv", "fav", "cart", "buy"))), F.col("behavior_type")).alias("behavior_name"),
        F.col("time").cast("date").cast("string").alias("behavior_date"),
        F.hour("time").alias("behavior_hour"),
        F.weekday("time").alias("weekday"),
    )
