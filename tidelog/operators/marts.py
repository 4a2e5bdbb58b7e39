"""Tables and figures that dashboards read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.expr import quantiles, safe_rate
from tidelog.operators.stats import top


def item_mart(items: DataFrame) -> DataFrame:
    return items.select("item_id", "item_total_count", "item_pv_count", "item_buy_count", "item_buy_to_pv_rate")


def category_mart(categories: DataFrame) -> DataFrame:
    return categories.select(
        "category_id", "category_total_count", "category_pv_count", "category_buy_count", "category_buy_to_pv_rate"
    )


def user_depth_mart(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id",
        "user_total_count",
        "user_active_day_count",
        "user_unique_item_count",
        "user_unique_category_count",
        "user_activity_level",
        "user_is_buyer",
    )


def kpis(users: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: users, buyers, rows and buys by user, items and categories, and the buy rate of views."""
    u = users.agg(
        F.count("*").alias("users"),
        F.sum("user_is_buyer").alias("buyers"),
        F.sum("user_total_count").alias("behaviors"),
        F.sum("user_pv_count").alias("pv"),
        F.sum("user_buy_count").alias("buys"),
    )
    count = lambda df: df.agg(F.count("*")).scalar()
    return u.select("*", count(items).alias("items"), count(categories).alias("categories"), safe_rate(F.col("buys"), F.col("pv")).alias("buy_rate"))


def item_scatter(items: DataFrame, least_pv: int = 5, n: int = 5000) -> DataFrame:
    """The items with the most rows among those seen ``least_pv`` times or more."""
    rows = items.where((F.col("item_pv_count") >= least_pv) & (F.col("item_total_count") > 0))
    return top(rows, "item_total_count", "item_id", n).select("item_id", "item_total_count", "item_pv_count", "item_buy_to_pv_rate")


def category_scatter(categories: DataFrame, n: int = 3000) -> DataFrame:
    rows = categories.where((F.col("category_pv_count") > 0) & (F.col("category_total_count") > 0))
    return top(rows, "category_total_count", "category_id", n).select(
        "category_id", "category_total_count", "category_pv_count", "category_buy_to_pv_rate"
    )


def category_segments(categories: DataFrame) -> DataFrame:
    """``hot`` from the 80 % quantile of totals on, else ``long_tail`` up to the 20 % quantile, else ``normal``."""
    total = F.col("category_total_count")
    low, high = quantiles(categories.select("category_total_count"), "category_total_count", (0.2, 0.8))
    segment = F.when(total >= high, "hot").when(total <= low, "long_tail").otherwise("normal")
    return categories.select("category_id", "category_total_count", "category_buy_count", "category_buy_to_pv_rate", segment.alias("segment"))


def segment_summary(segments: DataFrame) -> DataFrame:
    """Figures of each segment: hot, normal, long tail, in this order."""
    out = segments.groupBy("segment").agg(
        F.count("*").alias("categories"),
        F.sum("category_total_count").alias("total_count"),
        F.sum("category_buy_count").alias("buy_count"),
        F.round(F.avg("category_buy_to_pv_rate"), 6).alias("avg_buy_rate"),
    )
    return out.orderBy(F.array_position(F.array(*map(F.lit, ("hot", "normal", "long_tail"))), F.col("segment")))
