"""Descriptive statistics of the clean log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.expr import behaviour_counts, safe_rate, share
from tidelog.sources.schema import BEHAVIORS

NAMES = list(BEHAVIORS.values())
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def behavior_distribution(c: DataFrame) -> DataFrame:
    counts = c.where(F.col("behavior_name").isin(*NAMES)).groupBy("behavior_name").agg(F.count("*").alias("behavior_count"))
    total = F.sum("behavior_count").over(Window.partitionBy())  # over four rows at most
    out = counts.select("behavior_name", "behavior_count", share(F.col("behavior_count"), total).alias("percentage"))
    return out.orderBy(F.desc("behavior_count"), "behavior_name")


def behavior_statistics(c: DataFrame) -> DataFrame:
    """Users, buying rows, buyers, others, and buyers of two rows or more, by one row per user."""
    users = c.groupBy("user_id").agg(F.count_if(F.col("behavior_type") == 4).alias("b"))
    return users.agg(
        F.count("*").alias("total_users"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("total_purchases"),
        F.count_if(F.col("b") >= 1).alias("buyers"),
        F.count_if(F.col("b") == 0).alias("non_buyers"),
        F.count_if(F.col("b") >= 2).alias("repeat_buyers"),
    )


def item_statistics(c: DataFrame) -> DataFrame:
    return c.groupBy("item_id").agg(*behaviour_counts(""))


def item_statistics_pivot(c: DataFrame) -> DataFrame:
    """The same by a pivot with a fixed list of values."""
    out = c.groupBy("item_id").pivot("behavior_name", NAMES).count().na.fill(0)
    return out.select("item_id", *(F.col(n).alias(f"{n}_count") for n in NAMES))


def top(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows greatest in ``by``; ties go to the smaller ``key``."""
    return df.orderBy(F.desc(by), F.asc(key)).limit(n)


def category_statistics(c: DataFrame) -> DataFrame:
    counts = c.groupBy("category_id").agg(F.count("*").alias("total_count"), F.count_if(F.col("behavior_type") == 4).alias("buy_count"))
    total = counts.agg(F.sum("buy_count")).scalar()
    return counts.select("category_id", "total_count", "buy_count", share(F.col("buy_count"), total).alias("buy_share"))


def daily_behavior(c: DataFrame) -> DataFrame:
    return c.groupBy("behavior_date").agg(F.count("*").alias("behavior_count"))


def hourly_behavior(c: DataFrame) -> DataFrame:
    return c.groupBy("behavior_hour").agg(F.count("*").alias("behavior_count"))


def hourly_pivot(c: DataFrame) -> DataFrame:
    order = ["pv", "fav", "cart", "buy"]
    return c.groupBy("behavior_hour").pivot("behavior_name", order).count().na.fill(0).select("behavior_hour", *order)


def descriptive_funnel(c: DataFrame) -> DataFrame:
    """Stage, rows and per cent of views; one scan, then one row unfolded into four."""
    one = c.agg(*behaviour_counts(""))
    stages = ", ".join(f"'{n}', {n}_count, pv_count" for n in NAMES)
    return one.selectExpr(f"stack(4, {stages}) AS (stage, behavior_count, pv)").select(
        "stage", "behavior_count", share(F.col("behavior_count"), F.col("pv")).alias("pct_of_pv")
    )


def conversion_features(c: DataFrame) -> DataFrame:
    one = c.agg(*behaviour_counts(""))
    rate = lambda a, b: safe_rate(F.col(f"{b}_count"), F.col(f"{a}_count")).alias(f"{a}_to_{b}_rate")
    return one.select("*", rate("pv", "fav"), rate("pv", "cart"), rate("pv", "buy"), rate("fav", "buy"), rate("cart", "buy"))


def conversion_rates_unpivot(c: DataFrame) -> DataFrame:
    names = ["pv_to_fav_rate", "pv_to_cart_rate", "pv_to_buy_rate", "fav_to_buy_rate", "cart_to_buy_rate"]
    return conversion_features(c).select(*names).unpivot([], names, "metric", "rate")


def time_summary(c: DataFrame) -> DataFrame:
    """Counts by hour, weekday and kind of day from one scan with grouping sets.

    In order: hours from 0, days from Monday, then working days before weekends.
    """
    rows = c.select(
        F.col("behavior_hour").cast("string").alias("hour"),
        F.element_at(F.array(*map(F.lit, DAYS)), F.col("weekday") + 1).alias("weekday"),
        F.when(F.col("weekday") >= 5, "weekend").otherwise("weekday").alias("day_type"),
        "behavior_type",
    )
    dims = [F.col("hour"), F.col("weekday"), F.col("day_type")]
    grouped = rows.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("g"), F.count("*").alias("behavior_count"), *behaviour_counts("")
    )
    name = F.when(F.col("g") == 3, "hour").when(F.col("g") == 5, "weekday").otherwise("day_type")
    out = grouped.select(name.alias("time_dimension"), F.coalesce(*dims).alias("time_value"), "behavior_count", *(f"{n}_count" for n in NAMES))
    place = lambda column, values: F.array_position(F.array(*map(F.lit, values)), F.col(column))
    hour = F.when(F.col("time_dimension") == "hour", F.col("time_value").try_cast("int"))
    return out.orderBy(place("time_dimension", ("hour", "weekday", "day_type")), hour, place("time_value", (*DAYS, "weekday", "weekend")))


def peak_hours(c: DataFrame, q: float = 0.8) -> DataFrame:
    """Hours whose total reaches the quantile, and the others: joined hours and summed counts."""
    from tidelog.functions.expr import quantile

    cube = c.groupBy("behavior_hour").agg(F.count("*").alias("behavior_count"), *behaviour_counts(""))
    kind = F.when(F.col("behavior_count") >= quantile(cube, "behavior_count", q), "Peak").otherwise("Non-Peak")
    hours = F.array_join(F.transform(F.array_sort(F.collect_list("behavior_hour")), lambda x: x.cast("string")), "|")
    return cube.groupBy(kind.alias("hour_type")).agg(
        hours.alias("hours"), F.sum("behavior_count").alias("behavior_count"), *(F.sum(f"{n}_count").alias(f"{n}_count") for n in NAMES)
    )
