"""Sequences of a user's rows: recent actions, gaps, chains and adjacent transitions.

Rows of a user are ordered by (time, item_id, behavior_type); those of a pair by (time,
behavior_type). Behaviour codes grow along the funnel, so rows of one hour count in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import ranges
from tidelog.operators.features import last_n

NEWEST = ("time", "item_id", "behavior_type")


def _newest() -> list[Column]:
    return [F.desc(c) for c in NEWEST]


def _in_order(value: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("k"), F.col(value).alias("v"))))
    return F.transform(rows, lambda x: x["v"])


def recent_10(c: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` behaviour codes of each user, oldest first."""
    codes = _in_order("behavior_type").cast("array<bigint>")
    return last_n(c, ["user_id"], _newest(), n).groupBy("user_id").agg(codes.alias(f"sequence_recent_{n}_behavior_types"))


def avg_gap_hours(c: DataFrame) -> DataFrame:
    """The mean gap between rows: gaps add up to last less first time. 0 for a single row."""
    seconds = F.timestamp_diff("SECOND", F.min("time"), F.max("time")).cast("double")
    gap = F.when(F.count("*") > 1, seconds / F.lit(3600.0) / (F.count("*") - 1).cast("double")).otherwise(F.lit(0.0))
    return c.groupBy("user_id").agg(gap.alias("sequence_avg_behavior_gap_hours"))


def chain_flags(c: DataFrame) -> DataFrame:
    """Whether a user ever went on from a view of an item to fav, cart, buy, or cart and then buy.

    With p the first view of the pair, a later step exists if its greatest time is p or later.
    The cart that counts is the first from p on, which needs p beside each row: pairs are joined
    with their first view rather than put through a running maximum.
    """
    at = lambda code: F.when(F.col("behavior_type") == code, F.col("time"))
    pairs = c.groupBy("user_id", "item_id").agg(
        F.min(at(1)).alias("p"), F.max(at(2)).alias("fav"), F.max(at(3)).alias("cart"), F.max(at(4)).alias("buy")
    )
    carts = (
        c.where("behavior_type = 3")
        .select("user_id", "item_id", F.col("time").alias("t"))
        .join(pairs.where("p IS NOT NULL AND cart >= p AND buy IS NOT NULL").select("user_id", "item_id", "p"), ["user_id", "item_id"])
        .where("t >= p")
        .groupBy("user_id", "item_id")
        .agg(F.min("t").alias("first_cart"))
    )
    yes = lambda x: F.coalesce(F.max(F.coalesce(x, F.lit(False)).cast("int")), F.lit(0))
    return (
        pairs.join(carts, ["user_id", "item_id"], "left")
        .groupBy("user_id")
        .agg(
            yes(F.col("p") <= F.col("cart")).alias("sequence_has_pv_cart"),
            yes(F.col("p") <= F.col("fav")).alias("sequence_has_pv_fav"),
            yes(F.col("p") <= F.col("buy")).alias("sequence_has_pv_buy"),
            yes(F.col("first_cart") <= F.col("buy")).alias("sequence_has_pv_cart_buy"),
        )
    )


def chain_flags_windowed(c: DataFrame) -> DataFrame:
    """The same by running maxima over each pair; kept as the form that tests compare with."""
    w = Window.partitionBy("user_id", "item_id").orderBy("time", "behavior_type").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    code = F.col("behavior_type")
    seen = c.withColumn("pv", F.max((code == 1).cast("int")).over(w))
    seen = seen.withColumn("pc", F.max(((code == 3) & (F.col("pv") == 1)).cast("int")).over(w))
    flag = lambda k, by: F.max(((code == k) & (F.col(by) == 1)).cast("int"))
    return seen.groupBy("user_id").agg(
        flag(3, "pv").alias("sequence_has_pv_cart"),
        flag(2, "pv").alias("sequence_has_pv_fav"),
        flag(4, "pv").alias("sequence_has_pv_buy"),
        flag(4, "pc").alias("sequence_has_pv_cart_buy"),
    )


def sequence_features(c: DataFrame) -> DataFrame:
    """Recent codes, mean gap and chain flags, by full outer joins on the user."""
    flags = ["sequence_has_pv_cart", "sequence_has_pv_fav", "sequence_has_pv_buy", "sequence_has_pv_cart_buy"]
    out = recent_10(c).join(avg_gap_hours(c), "user_id", "full").join(chain_flags(c), "user_id", "full")
    return out.na.fill(0.0, ["sequence_avg_behavior_gap_hours"]).na.fill(0, flags)


def _recent_5(c: DataFrame) -> DataFrame:
    return last_n(c, ["user_id"], _newest(), 5)


def recent_5_actions(c: DataFrame) -> DataFrame:
    return _recent_5(c).groupBy("user_id").agg(F.array_join(_in_order("behavior_name"), "|").alias("recent_5_actions"))


def recent_5_interval(c: DataFrame) -> DataFrame:
    """Mean minutes between the last rows, two decimals; 0 for a single row."""
    seconds = F.timestamp_diff("SECOND", F.min("time"), F.max("time")).cast("double")
    gap = F.when(F.count("*") > 1, F.round(seconds / F.lit(60.0) / (F.count("*") - 1).cast("double"), 2)).otherwise(F.lit(0.0))
    return _recent_5(c).groupBy("user_id").agg(gap.alias("avg_recent_5_interval_min"))


def _leads(c: DataFrame) -> DataFrame:
    """The behaviours of the next three rows of each pair, by stretches of equal length: a pair of very many rows is no hot task."""
    return ranges.leads(c.select("user_id", "item_id", "time", "behavior_type", "behavior_name"), ["user_id", "item_id"], ["time", "behavior_type"], "behavior_name", 3)


def _transitions() -> list[Column]:
    step = lambda n: F.count_if((F.col("behavior_name") == "pv") & (F.col("n1") == n)).alias(f"pv_to_{n}_count")
    return [step("fav"), step("cart"), step("buy")]


def _chains() -> Column:
    is_ = lambda *names: F.coalesce(
        (F.col("behavior_name") == "pv") & F.array_join(F.array(*(f"n{i + 1}" for i in range(len(names)))), ",").eqNullSafe(",".join(names)), F.lit(False)
    )
    chain = is_("fav", "buy") | is_("cart", "buy") | is_("fav", "cart", "buy")
    return F.max(chain.cast("int")).alias("has_behavior_chain")


def adjacent_transitions(c: DataFrame) -> DataFrame:
    """Rows of a user where a view of an item is followed at once by fav, cart or buy of it."""
    return _leads(c).groupBy("user_id").agg(*_transitions())


def adjacent_chains(c: DataFrame) -> DataFrame:
    """Whether pv-fav-buy, pv-cart-buy or pv-fav-cart-buy of an item occurs without a gap."""
    return _leads(c).groupBy("user_id").agg(_chains())


def recent_path_features(c: DataFrame) -> DataFrame:
    """Recent actions and their mean gap, transitions and chains; the last two of one look ahead."""
    gap = F.timestamp_diff("SECOND", F.min("time"), F.max("time")).cast("double")
    recent = _recent_5(c).groupBy("user_id").agg(
        F.array_join(_in_order("behavior_name"), "|").alias("recent_5_actions"),
        F.when(F.count("*") > 1, F.round(gap / F.lit(60.0) / (F.count("*") - 1).cast("double"), 2)).otherwise(F.lit(0.0)).alias("avg_recent_5_interval_min"),
    )
    return recent.join(_leads(c).groupBy("user_id").agg(*_transitions(), _chains()), "user_id", "left").na.fill(0)
