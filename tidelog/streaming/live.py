"""An extension beyond the batch engine: the same cleaning over an unbounded log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.expr import behaviour_counts
from tidelog.operators.cleaning import analyse, clean


def hourly_counts(raw: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Rows per hour of event time and their behaviours; rows later than ``lateness`` are dropped.

    ``raw`` is a streaming (or batch) raw log. State is one row per open hour.
    """
    rows = clean(analyse(raw)).withColumn("ts", F.col("time").cast("timestamp"))
    hour = F.window("ts", "1 hour").alias("w")
    return (
        rows.withWatermark("ts", lateness)
        .groupBy(hour)
        .agg(F.count("*").alias("total_count"), *behaviour_counts(""))
        .select(F.col("w.start").alias("hour"), "total_count", *(f"{n}_count" for n in ("pv", "fav", "cart", "buy")))
    )
