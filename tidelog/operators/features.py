"""Feature tables by user, item, category, hour and pair, and the wide table that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.expr import hours_between, is_weekend, quantile, quantiles, rates_to_pv, safe_rate, time_period
from tidelog.sources.schema import BEHAVIORS

_NAMES = list(BEHAVIORS.values())
_CELL = ["user_id", "item_id", "category_id", "behavior_date", "behavior_hour", "weekday"]


def _counted(c: DataFrame) -> DataFrame:
    """Rows of the log as cells of one row each; cells stay."""
    if "rows" in c.columns:
        return c
    return c.select(
        *(k for k in _CELL if k in c.columns),
        F.lit(1).cast("long").alias("rows"),
        *((F.col("behavior_type") == code).cast("long").alias(name) for code, name in BEHAVIORS.items()),
        F.col("time").alias("first"),
        F.col("time").alias("last"),
    )


def cells(c: DataFrame) -> DataFrame:
    """The log by user, item, category and hour: rows, rows of each behaviour, first and last time.

    All feature tables can be made of it. Written once, it spares them a scan of the log each.
    """
    x = _counted(c)
    return x.groupBy(*_CELL).agg(*(F.sum(n).alias(n) for n in ("rows", *_NAMES)), F.min("first").alias("first"), F.max("last").alias("last"))


def _pairs(x: DataFrame, *keys: str) -> DataFrame:
    """Cells summed up by coarser keys. Distinct values are counted as rows of such a table, so no row of the
    log is expanded, and a hot key is summed up in parts by its pairs first."""
    return x.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in ("rows", *_NAMES)), F.min("first").alias("first"), F.max("last").alias("last"))


def _totals(prefix: str) -> list[Column]:
    return [F.sum("rows").alias(f"{prefix}total_count"), *(F.sum(n).alias(f"{prefix}{n}_count") for n in _NAMES)]


def _number(x: DataFrame, key: list[str], of: str, name: str) -> DataFrame:
    """``key`` and the number of distinct values of a column."""
    return x.select(*key, of).distinct().groupBy(*key).agg(F.count("*").alias(name))


def user_features(c: DataFrame, reference: str) -> DataFrame:
    """One row per user of the log or of its cells; recency counts from the last row to ``reference``, the tier splits at the median total."""
    x = _counted(c)
    base = (
        _pairs(x, "user_id", "item_id")
        .groupBy("user_id")
        .agg(
            *_totals("user_"),
            F.count("*").alias("user_unique_item_count"),
            F.min("first").alias("user_first_behavior_time"),
            F.max("last").alias("user_last_behavior_time"),
        )
        .join(_number(x, ["user_id"], "category_id", "user_unique_category_count"), "user_id")
        .join(_number(x, ["user_id"], "behavior_date", "days"), "user_id")
        .withColumn("user_active_day_count", F.col("days").cast("int"))
    )
    median = quantile(x.groupBy("user_id").agg(F.sum("rows").alias("n")), "n", 0.5)
    total = F.col("user_total_count")
    return base.select(
        "user_id",
        "user_total_count",
        *(f"user_{n}_count" for n in ("pv", "fav", "cart", "buy")),
        "user_unique_item_count",
        "user_unique_category_count",
        "user_active_day_count",
        safe_rate(total, F.col("user_active_day_count")).alias("user_avg_daily_behavior_count"),
        F.when(total >= median, "high").otherwise("low").alias("user_activity_level"),
        hours_between(F.col("user_first_behavior_time"), F.col("user_last_behavior_time")).alias("user_behavior_span_hours"),
        "user_first_behavior_time",
        "user_last_behavior_time",
        hours_between(F.col("user_last_behavior_time"), F.lit(reference).cast("timestamp_ntz")).alias("user_recency_hours"),
        *rates_to_pv("user_"),
        (F.col("user_buy_count") >= 1).cast("int").alias("user_is_buyer"),
        (F.col("user_buy_count") >= 2).cast("int").alias("user_is_repeat_buyer"),
    )


def canonical_item_category(c: DataFrame) -> DataFrame:
    """(item_id, category_id): the most frequent category, of equal ones the smallest."""
    counts = _counted(c).groupBy("item_id", "category_id").agg(F.sum("rows").alias("n"))
    return counts.groupBy("item_id").agg(F.min_by("category_id", F.struct(-F.col("n"), "category_id")).alias("category_id"))


def item_features(c: DataFrame) -> DataFrame:
    x = _counted(c)
    base = (
        _pairs(x, "item_id", "user_id")
        .groupBy("item_id")
        .agg(*_totals("item_"), F.count("*").alias("item_unique_user_count"), F.count_if(F.col("buy") > 0).alias("item_unique_buyer_count"))
        .join(_number(x, ["item_id"], "behavior_date", "days"), "item_id")
    )
    return base.join(canonical_item_category(x), "item_id", "left").select(
        "item_id",
        "category_id",
        "item_total_count",
        *(f"item_{n}_count" for n in ("pv", "fav", "cart", "buy")),
        "item_unique_user_count",
        "item_unique_buyer_count",
        F.col("days").cast("int").alias("item_active_day_count"),
        *rates_to_pv("item_"),
    )


def category_features(c: DataFrame) -> DataFrame:
    x = _counted(c)
    base = (
        _pairs(x, "category_id", "user_id")
        .groupBy("category_id")
        .agg(*_totals("category_"), F.count("*").alias("category_unique_user_count"), F.count_if(F.col("buy") > 0).alias("category_unique_buyer_count"))
        .join(_number(x, ["category_id"], "item_id", "category_unique_item_count"), "category_id")
    )
    return base.select(
        "category_id",
        "category_total_count",
        *(f"category_{n}_count" for n in ("pv", "fav", "cart", "buy")),
        "category_unique_user_count",
        "category_unique_item_count",
        "category_unique_buyer_count",
        *rates_to_pv("category_"),
    )


def time_features(c: DataFrame) -> DataFrame:
    """Only hours that occur; the number of rows is bounded by the hours of the log."""
    x, key = _counted(c), ["behavior_date", "behavior_hour"]
    users = _pairs(x, *key, "weekday", "user_id").groupBy(*key)
    base = users.agg(F.min("weekday").alias("weekday"), *_totals("time_"), F.count("*").alias("time_unique_user_count"))
    return base.join(_number(x, key, "item_id", "time_unique_item_count"), key).select(
        F.to_date("behavior_date").alias("behavior_date"),
        "behavior_hour",
        "weekday",
        is_weekend(F.col("weekday")).alias("is_weekend"),
        time_period(F.col("behavior_hour")).alias("time_period"),
        "time_total_count",
        *(f"time_{n}_count" for n in ("pv", "fav", "cart", "buy")),
        "time_unique_user_count",
        "time_unique_item_count",
        *rates_to_pv("time_", ("buy",)),
    )


def user_item_features(c: DataFrame) -> DataFrame:
    last = F.col("ui_last_interaction_time")
    base = _pairs(_counted(c), "user_id", "item_id")
    return base.select("user_id", "item_id", *(F.col(n).alias(f"ui_{n}_count") for n in _NAMES), F.col("last").alias("ui_last_interaction_time")).select(
        "*",
        F.to_date(last).alias("ui_last_interaction_date"),
        F.hour(last).alias("ui_last_interaction_hour"),
        (F.col("ui_buy_count") > 0).cast("int").alias("ui_has_bought"),
    )


def item_conversion_features(c: DataFrame) -> DataFrame:
    base = _counted(c).groupBy("item_id").agg(*(F.sum(n).alias(f"{n}_count") for n in _NAMES))
    rate = lambda a, b: safe_rate(F.col(f"{b}_count"), F.col(f"{a}_count")).alias(f"item_{a}_to_{b}_rate")
    return base.select("item_id", rate("pv", "buy"), rate("pv", "cart"), rate("cart", "buy"), rate("fav", "buy"))


def user_activity_p20_p80(c: DataFrame) -> DataFrame:
    """Tiers at the 20 % and 80 % quantiles of totals, days between first and last row, rows per active day."""
    days = _pairs(_counted(c), "user_id", "behavior_date")
    base = days.groupBy("user_id").agg(
        F.sum("rows").alias("n"), F.count("*").alias("active_days"), F.max("last").alias("last_active_time"), F.min("first").alias("first")
    )
    totals = _counted(c).groupBy("user_id").agg(F.sum("rows").alias("n"))
    low, high = quantiles(totals, "n", (0.2, 0.8))
    return base.select(
        "user_id",
        "active_days",
        F.round(F.col("n").cast("double") / F.col("active_days").cast("double"), 2).alias("avg_daily_behavior"),
        "last_active_time",
        F.round(hours_between(F.col("first"), F.col("last_active_time")) / F.lit(24.0), 2).alias("behavior_span_days"),
        F.when(F.col("n") >= high, "High").when(F.col("n") < low, "Low").otherwise("Medium").alias("activity_level"),
    )


def heat(features: DataFrame, key: str, total: str, labels: tuple[str, str, str]) -> DataFrame:
    """``key``, total and its tier: below the first quartile, between, from the third on."""
    low, high = quantiles(features.select(total), total, (0.25, 0.75))
    tier = F.when(F.col(total) < low, labels[0]).when(F.col(total) >= high, labels[2]).otherwise(labels[1])
    return features.select(key, F.col(total).alias("total_count"), tier.alias("heat"))


def wide_user_item(c: DataFrame, reference: str, sequences: DataFrame) -> DataFrame:
    """User-item pairs with the features of user, sequence, item, item conversion, category and hour.

    ``c`` is the log, or its cells, which should be written first: every table here reads them.
    Each right side has one row per key, so rows stay those of the pairs; counts and flags that
    find no partner become 0, tiers ``unknown``.
    """
    item = item_features(c)
    rate = lambda a, b: safe_rate(F.col(f"item_{b}_count"), F.col(f"item_{a}_count")).alias(f"item_{a}_to_{b}_rate")
    item = item.select("*", rate("pv", "buy"), rate("pv", "cart"), rate("cart", "buy"), rate("fav", "buy"))
    hour = time_features(c).select(
        F.col("behavior_date").alias("ui_last_interaction_date"),
        F.col("behavior_hour").alias("ui_last_interaction_hour"),
        "weekday",
        "is_weekend",
        "time_period",
        "time_total_count",
        "time_buy_to_pv_rate",
    )
    return (
        user_item_features(c)
        .join(user_features(c, reference).join(sequences, "user_id", "left"), "user_id", "left")
        .join(item.join(category_features(c), "category_id", "left"), "item_id", "left")
        .join(hour, ["ui_last_interaction_date", "ui_last_interaction_hour"], "left")
        .na.fill(0)
        .na.fill("unknown", ["user_activity_level", "time_period"])
    )


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with their place ``rn`` from 1.

    Spark cuts each task's rows to ``n`` of a key before it shuffles them, so of a key with very many rows only ``n``
    for each task meet.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= n)
