"""Checks of tables: keys, reconciliation, rules, and the clean log read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.sources.schema import BEHAVIORS, CLEAN, DEFAULT_BURST, require_schema

#: Primary keys of the feature tables.
KEYS = {
    "user_features": ["user_id"],
    "item_features": ["item_id"],
    "category_features": ["category_id"],
    "time_features": ["behavior_date", "behavior_hour"],
    "user_item_features": ["user_id", "item_id"],
}


class ValidationError(ValueError):
    """A table breaks its contract."""


def pk_check(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row: rows, rows with a null in the key, and rows after the first of a key."""
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.lit(name).alias("table_name"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def pk_checks(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (pk_check(df, KEYS[name], name) for name, df in tables.items()))


def reconciliation(tables: dict[str, tuple[DataFrame, Column]], clean: DataFrame) -> DataFrame:
    """For each table, whether its counts add up to the rows of the clean log."""
    rows = clean.agg(F.count("*")).scalar()
    parts = (
        df.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum(total), F.lit(0)).alias("total_count")).select(
            "table_name", "total_count", rows.alias("clean_rows"), (F.col("total_count") == rows).alias("matches")
        )
        for name, (df, total) in tables.items()
    )
    return reduce(DataFrame.unionByName, parts)


def rule_frame(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, failures, status): rows for which a rule does not hold, all rules in one scan."""
    one = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return one.unpivot([], list(rules), "rule", "failures").withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def feature_rules() -> dict[str, dict[str, Column]]:
    """Rules on rows of the user, hour and sequence tables."""
    c = F.col
    flag = lambda name: c(name).isin(0, 1)
    parts = lambda p: c(f"{p}pv_count") + c(f"{p}fav_count") + c(f"{p}cart_count") + c(f"{p}buy_count")
    return {
        "user_features": {
            "user_id_present": c("user_id").isNotNull(),
            "user_total_positive": c("user_total_count") > 0,
            "user_average_not_negative": c("user_avg_daily_behavior_count") >= 0,
            "user_counts_add_up": parts("user_") == c("user_total_count"),
            "user_active_days_positive": c("user_active_day_count") >= 1,
            "user_span_not_negative": c("user_behavior_span_hours") >= 0,
            "user_recency_not_negative": c("user_recency_hours") >= 0,
            "user_level_known": c("user_activity_level").isin("high", "low"),
            "user_rates_not_negative": (c("user_fav_to_pv_rate") >= 0) & (c("user_cart_to_pv_rate") >= 0) & (c("user_buy_to_pv_rate") >= 0),
            "user_buyer_flag": flag("user_is_buyer"),
            "user_repeat_flag": flag("user_is_repeat_buyer"),
            "user_repeat_implies_buyer": c("user_is_repeat_buyer") <= c("user_is_buyer"),
        },
        "time_features": {
            "time_hour_in_range": c("behavior_hour").between(0, 23),
            "time_weekday_in_range": c("weekday").between(0, 6),
            "time_weekend_flag": flag("is_weekend"),
            "time_weekend_agrees": c("is_weekend") == (c("weekday") >= 5).cast("int"),
            "time_period_known": c("time_period").isin("night", "morning", "afternoon", "evening"),
            "time_counts_add_up": parts("time_") == c("time_total_count"),
        },
        "sequence_features": {
            "sequence_user_present": c("user_id").isNotNull(),
            "sequence_length": F.size("sequence_recent_10_behavior_types").between(1, 10),
            "sequence_codes": F.forall("sequence_recent_10_behavior_types", lambda x: x.isin(*BEHAVIORS)),
            "sequence_gap_not_negative": c("sequence_avg_behavior_gap_hours") >= 0,
            "sequence_pv_cart_flag": flag("sequence_has_pv_cart"),
            "sequence_pv_fav_flag": flag("sequence_has_pv_fav"),
            "sequence_pv_buy_flag": flag("sequence_has_pv_buy"),
            "sequence_pv_cart_buy_flag": flag("sequence_has_pv_cart_buy"),
            "sequence_chain_implies_steps": c("sequence_has_pv_cart_buy") <= F.least("sequence_has_pv_cart", "sequence_has_pv_buy"),
        },
    }


def key_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, failures, status): rows beyond the first of a key, and rows without one, by table."""
    keys = {name: KEYS.get(name, ["user_id"]) for name in tables}
    found = reduce(DataFrame.unionByName, (pk_check(df, keys[name], name) for name, df in tables.items()))
    rule = lambda kind: F.struct(F.concat("table_name", F.lit(f"_{kind}")).alias("rule"), F.col(kind).alias("failures"))
    return found.select(F.inline(F.array(rule("duplicate_keys"), rule("null_keys"))))


def cross_rules(users: DataFrame, sequences: DataFrame) -> DataFrame:
    """(rule, failures): by how many users the tables differ in number, and users that only one of them has."""
    side = lambda df, name: df.select("user_id").distinct().withColumn(name, F.lit(1))
    both = side(users, "a").join(side(sequences, "b"), "user_id", "full")
    one = both.agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("apart"))
    return one.select(
        F.inline(
            F.array(
                F.struct(F.lit("same_user_count").alias("rule"), F.abs(F.col("a") - F.col("b")).alias("failures")),
                F.struct(F.lit("same_user_set").alias("rule"), F.col("apart").alias("failures")),
            )
        )
    )


def feature_qa_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, failures, status) of the user, hour and sequence tables: rows, keys, and users across tables."""
    rows = reduce(DataFrame.unionByName, (rule_frame(tables[name], rules) for name, rules in feature_rules().items()))
    more = key_rules(tables).unionByName(cross_rules(tables["user_features"], tables["sequence_features"]))
    return rows.unionByName(more.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL")))


#: The columns whose values a report counts, by table.
SPREAD = {
    "user_features": ["user_activity_level", "user_is_buyer", "user_is_repeat_buyer"],
    "time_features": ["is_weekend", "time_period"],
    "sequence_features": [f"sequence_has_{x}" for x in ("pv_cart", "pv_fav", "pv_buy", "pv_cart_buy")],
}


def distributions(tables: dict[str, DataFrame]) -> DataFrame:
    """(feature, value, n): rows of each value of tiers, flags and periods. Each table is read once for all its columns."""
    parts = []
    for name, columns in SPREAD.items():
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns)))
        parts.append(tables[name].select(each.alias("x")).groupBy("x.feature", "x.value").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def user_set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: users that only one of the tables has, and whether the sets agree."""
    sides = a.select("user_id", F.lit(1).alias("left"), F.lit(0).alias("right")).union(b.select("user_id", F.lit(0), F.lit(1)))
    each = sides.groupBy("user_id").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    only = lambda x, y: F.count_if((F.col(x) == 1) & (F.col(y) == 0)).alias(f"only_{x}")
    return each.agg(only("left", "right"), only("right", "left")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def validate_clean(clean: DataFrame, expected_rows: int | None = None, threshold: int = DEFAULT_BURST, start=None, end=None) -> dict:
    """Checks a clean log that was read again, and returns its figures; raises ValidationError.

    One aggregation for all row checks, and one over the four-field keys.
    """
    require_schema(clean.select(*CLEAN.fieldNames()), CLEAN)
    c = F.col
    name = F.element_at(F.create_map(*(F.lit(x) for kv in BEHAVIORS.items() for x in kv)), c("behavior_type"))
    rules = {
        "no_nulls": reduce(lambda a, b: a & b, (c(n).isNotNull() for n in CLEAN.fieldNames())),
        "positive_ids": (c("user_id") > 0) & (c("item_id") > 0) & (c("category_id") > 0),
        "known_behavior": c("behavior_type").isin(*BEHAVIORS),
        "name_agrees": c("behavior_name") == F.when(c("behavior_type").isin(*BEHAVIORS), name),
        "date_agrees": c("behavior_date") == F.date_format("time", "yyyy-MM-dd"),
        "hour_agrees": c("behavior_hour") == F.hour("time"),
        "weekday_agrees": c("weekday") == F.weekday("time"),
    }
    if start is not None:
        rules["not_before_start"] = c("time") >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        rules["not_after_end"] = c("time") <= F.lit(end).cast("timestamp_ntz")
    row = clean.agg(F.count("*").alias("rows"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(k) for k, ok in rules.items())).first()
    if row["rows"] == 0:
        raise ValidationError("the clean log is empty")
    if broken := {k: row[k] for k in rules if row[k]}:
        raise ValidationError(f"rows that break rules: {broken}")
    if expected_rows is not None and row["rows"] != expected_rows:
        raise ValidationError(f"expected {expected_rows} rows, found {row['rows']}")
    keys = clean.groupBy("time", "user_id", "item_id", "behavior_type").agg(F.count("*").alias("n"))
    k = keys.agg(F.count("*").alias("unique_keys"), F.sum(F.col("n") - 1).alias("preserved_repeats"), F.max("n").alias("max_group")).first()
    if k["max_group"] >= threshold:
        raise ValidationError(f"a key has {k['max_group']} rows; the threshold is {threshold}")
    return {"rows": row["rows"], **k.asDict()}


def reconcile_removals(total: int, kept: int, reasons: dict[str, int]) -> None:
    """Raises unless removed rows are the sum of the reasons."""
    if total - kept != sum(reasons.values()):
        raise ValidationError(f"{total} - {kept} rows, but the reasons give {reasons}")


