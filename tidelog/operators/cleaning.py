"""Validation and cleaning of the raw log: masks, one reason per removed row, repeat bursts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.functions.expr import behaviour_name, strip
from tidelog.sources.schema import BEHAVIORS, DEFAULT_BURST, RAW_COLUMNS, require_columns

# Reasons for removal in order of priority.
REASONS = (
    "missing_critical_field",
    "invalid_behavior_type",
    "invalid_id",
    "unparseable_time",
    "out_of_time_range",
    "suspicious_repeat",
)
IDS = ("user_id", "item_id", "item_category")
BURST_KEY = ("time", "user_id", "item_id", "behavior_type")


def valid_id(c: Column) -> Column:
    """Digits only, positive, and within 64 bits; leading zeros are allowed."""
    return c.rlike(r"^[0-9]+\z") & F.coalesce(c.try_cast("bigint") > 0, F.lit(False))


def parse_hour(c: Column) -> Column:
    """A timestamp of exactly ``yyyy-MM-dd HH``, else null; years outside 1678 to 2261 are null too."""
    hour = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}\z")
    time = F.when(hour, F.concat(c, F.lit(":00:00")).try_cast("timestamp_ntz"))  # much faster than a format
    first, last = (F.lit(x).cast("timestamp_ntz") for x in ("1678-01-01 00:00:00", "2261-12-31 23:00:00"))
    return F.when(time.between(first, last), time)


def parse_bound(value: str) -> datetime.datetime:
    """A bound of time, exactly ``yyyy-MM-dd HH``; ValueError if it is none."""
    if len(value) != 13:
        raise ValueError(f"{value!r} is not of the form yyyy-MM-dd HH")
    return datetime.datetime.strptime(value, "%Y-%m-%d %H")


def analyse(raw: DataFrame, allowed_start: str | None = None, allowed_end: str | None = None) -> DataFrame:
    """``raw`` with stripped fields ``s_*``, masks, ``parsed_time``, ``removal_reason`` (null: base valid) and ``base_valid``.

    Masks overlap; the reason is the first that holds. Bounds are inclusive ``yyyy-MM-dd HH``.
    """
    require_columns(raw, RAW_COLUMNS)
    bounds = {}
    for name, value in (("start", allowed_start), ("end", allowed_end)):
        if value is not None:
            bounds[name] = parse_bound(value)
    if len(bounds) == 2 and bounds["start"] > bounds["end"]:
        raise ValueError("allowed_start is after allowed_end")
    bounds = {name: F.lit(value).cast("timestamp_ntz") for name, value in bounds.items()}
    s = {c: F.col(f"s_{c}") for c in RAW_COLUMNS}
    missing = {c: s[c] == "" for c in RAW_COLUMNS}
    any_of = lambda cols: F.array_contains(F.array(*cols), True)
    df = raw.withColumns({f"s_{c}": strip(F.coalesce(c, F.lit(""))) for c in RAW_COLUMNS})
    df = df.withColumns(
        {
            **{f"missing_{c}": missing[c] for c in RAW_COLUMNS},
            **{f"bad_{c}": ~missing[c] & ~valid_id(s[c]) for c in IDS},
            "bad_behavior": ~missing["behavior_type"] & ~s["behavior_type"].isin(*map(str, BEHAVIORS)),
            "parsed_time": parse_hour(s["time"]),
        }
    )
    time = F.col("parsed_time")
    outside = F.lit(False)
    if "start" in bounds:
        outside = outside | (time < bounds["start"])
    if "end" in bounds:
        outside = outside | (time > bounds["end"])
    df = df.withColumns(
        {
            "missing_any": any_of([F.col(f"missing_{c}") for c in RAW_COLUMNS]),
            "bad_id_any": any_of([F.col(f"bad_{c}") for c in IDS]),
            "bad_time": ~missing["time"] & time.isNull(),
            "out_of_range": F.coalesce(outside, F.lit(False)),
        }
    )
    reason = F.lit(None).cast("string")
    for name, mask in reversed(list(zip(REASONS, ("missing_any", "bad_behavior", "bad_id_any", "bad_time", "out_of_range")))):
        reason = F.when(F.col(mask), name).otherwise(reason)
    # the same as "no reason", but short: as a filter it is pushed down with all that it is made of
    valid = s["behavior_type"].isin(*map(str, BEHAVIORS))
    for c in IDS:
        valid = valid & valid_id(s[c])
    valid = valid & F.col("parsed_time").isNotNull()
    if bounds:
        valid = valid & ~F.col("out_of_range")
    return df.withColumns({"removal_reason": reason, "base_valid": valid})


def clean(analysed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The base-valid rows of ``analyse`` in the clean schema, then ``keep`` columns."""
    code, time = F.col("s_behavior_type").cast("int"), F.col("parsed_time")
    return analysed.where("base_valid").select(
        time.alias("time"),
        F.col("s_user_id").try_cast("bigint").alias("user_id"),
        F.col("s_item_id").try_cast("bigint").alias("item_id"),
        F.col("s_item_category").try_cast("bigint").alias("category_id"),
        code.alias("behavior_type"),
        behaviour_name(code).alias("behavior_name"),
        time.cast("date").cast("string").alias("behavior_date"),
        F.hour(time).alias("behavior_hour"),
        F.weekday(time).alias("weekday"),
        *keep,
    )


def burst_groups(df: DataFrame, threshold: int = DEFAULT_BURST, bucket: str = "hour", position: str = "event_id") -> DataFrame:
    """Keys (bucket of time, user, item, behaviour) with ``threshold`` rows or more: count and first position.

    The category is not part of the key. Counting has partial sums, so a key of very many rows
    is no hot task.
    """
    if threshold < 2:
        raise ValueError("the threshold must be 2 or more")
    return (
        df.groupBy(F.date_trunc(bucket, "time").alias("bucket"), "user_id", "item_id", "behavior_type")
        .agg(F.count("*").alias("group_rows"), F.min(position).alias("first_position"))
        .where(F.col("group_rows") >= threshold)
    )


def collapse_bursts(df: DataFrame, threshold: int = DEFAULT_BURST, bucket: str = "hour", position: str = "event_id") -> DataFrame:
    """``df`` with each burst reduced to its first row by ``position``, which must be unique."""
    return without_bursts(df, burst_groups(df, threshold, bucket, position), bucket, position)


def without_bursts(df: DataFrame, bursts: DataFrame, bucket: str = "hour", position: str = "event_id") -> DataFrame:
    """``df`` with each of the ``bursts`` that were found in it reduced to its first row."""
    groups = bursts.select(
        F.col("bucket").alias("__b"), F.col("user_id").alias("__u"), F.col("item_id").alias("__i"), F.col("behavior_type").alias("__t"), "first_position"
    )
    on = (
        (F.date_trunc(bucket, "time") == F.col("__b"))
        & (F.col("user_id") == F.col("__u"))
        & (F.col("item_id") == F.col("__i"))
        & (F.col("behavior_type") == F.col("__t"))
    )
    joined = df.join(groups, on, "left")
    return joined.where(F.col("first_position").isNull() | (F.col("first_position") == F.col(position))).select(*df.columns)


def burst_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, rows in them, rows that a collapse removes, and the largest group."""
    n = F.col("group_rows")
    return groups.agg(
        F.count("*").alias("burst_groups"),
        F.coalesce(F.sum(n), F.lit(0)).alias("burst_rows"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("removable_rows"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_group_rows"),
    )


def _counters() -> list[Column]:
    masks = {f"missing_{c}": f"missing_{c}" for c in RAW_COLUMNS} | {
        "missing_any": "missing_any",
        "invalid_behavior": "bad_behavior",
        **{f"invalid_{c}": f"bad_{c}" for c in IDS},
        "invalid_id_any": "bad_id_any",
        "unparseable_time": "bad_time",
        "out_of_range": "out_of_range",
    }
    return [F.count("*").alias("total_rows"), *(F.count_if(mask).alias(name) for name, mask in masks.items())]


def quality_counters(analysed: DataFrame) -> DataFrame:
    """One row of overlapping counts of each fault."""
    return analysed.agg(*_counters())


#: The raw behaviour codes that a report names; all others together are ``<other>``.
KNOWN_VALUES = ("<missing>", *map(str, BEHAVIORS), "<other>")


def observed(analysed: DataFrame, name: str = "cleaning") -> tuple[DataFrame, Observation]:
    """``analysed`` with all figures that need no grouping, gathered while it is read for something else.

    ``figures`` turns what was observed into counters, reasons, known codes and range of time. No
    pass of its own is made; the figures are there when the action over the DataFrame has ended.
    """
    value = F.when(F.col("s_behavior_type") == "", "<missing>").otherwise(F.col("s_behavior_type"))
    known = F.when(value.isin(*KNOWN_VALUES[:-1]), value).otherwise(F.lit("<other>"))
    seen = Observation(name)
    exprs = [
        *_counters(),
        *(F.count_if(F.col("removal_reason") == reason).alias(f"reason {reason}") for reason in REASONS[:-1]),
        *(F.count_if(known == x).alias(f"value {x}") for x in KNOWN_VALUES),
        F.min("parsed_time").alias("min_time"),
        F.max("parsed_time").alias("max_time"),
    ]
    return analysed.observe(seen, *exprs), seen


def figures(seen: Observation) -> dict[str, dict]:
    """``counters``, ``reasons`` (those that occur), ``values`` (likewise) and ``time_range`` of an observation."""
    got = seen.get
    part = lambda head: {k.removeprefix(head): v for k, v in got.items() if k.startswith(head) and v}
    return {
        "counters": {k: v for k, v in got.items() if not k.startswith(("reason ", "value ")) and k not in ("min_time", "max_time")},
        "reasons": part("reason "),
        "values": part("value "),
        "time_range": {k: got[k] for k in ("min_time", "max_time")},
    }


def raw_groups(raw: DataFrame) -> DataFrame:
    """Each distinct raw row, not stripped, and how often it occurs (``n``): what distinct ids, duplicates and codes are counted of."""
    return raw.groupBy(*RAW_COLUMNS).agg(F.count("*").alias("n"))


def distinct_ids_of(groups: DataFrame) -> DataFrame:
    """``distinct_raw_ids`` from ``raw_groups``: one grouping for each column, so no row is expanded for each distinct count."""
    one = lambda c: groups.select(strip(F.coalesce(c, F.lit(""))).alias("v")).where("v <> ''").groupBy("v").agg(F.lit(1)).agg(F.count("*").alias(f"distinct_{c}"))
    first, *rest = (one(c) for c in IDS)
    for df in rest:
        first = first.join(df)  # of one row each
    return first


def duplicates_of(groups: DataFrame) -> DataFrame:
    """``duplicate_diagnostics`` from ``raw_groups``."""
    coarse = groups.groupBy(*(c for c in RAW_COLUMNS if c != "item_category")).agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    total, fine = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))
    return coarse.agg(total.alias("total_rows"), (total - fine).alias("full_duplicates"), (total - F.count("*")).alias("four_key_duplicates"))


def value_counts_of(groups: DataFrame) -> DataFrame:
    """``raw_value_counts`` from ``raw_groups``."""
    value = strip(F.coalesce("behavior_type", F.lit("")))
    return groups.groupBy(F.when(value == "", "<missing>").otherwise(value).alias("value")).agg(F.sum("n").alias("n"))


def removal_reasons(analysed: DataFrame) -> DataFrame:
    return analysed.groupBy(F.coalesce("removal_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def distinct_raw_ids(analysed: DataFrame) -> DataFrame:
    """Distinct strings per id column, invalid ones too, missing ones not.

    Equal combinations are grouped first; of these, not of raw rows, each column's values are.
    """
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"s_{c}").alias("v")) for c in IDS))).alias("x")
    equal = analysed.groupBy(*(f"s_{c}" for c in IDS)).agg(F.lit(1))
    each = equal.select(values).where("x.v <> ''").groupBy("x.c", "x.v").agg(F.lit(1))
    return each.agg(*(F.count_if(F.col("c") == c).alias(f"distinct_{c}") for c in IDS))


def duplicate_diagnostics(raw: DataFrame) -> DataFrame:
    """Rows after the first of each equal row, over five and over four raw fields, not stripped.

    Two grouped counts, each with partial sums, instead of one distinct count of long structs.
    """
    return duplicates_of(raw_groups(raw))


def raw_value_counts(analysed: DataFrame) -> DataFrame:
    value = F.when(F.col("s_behavior_type") == "", "<missing>").otherwise(F.col("s_behavior_type"))
    return analysed.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def known_value_counts(counts: DataFrame) -> DataFrame:
    """``raw_value_counts`` in a few rows: known codes, missing ones, and all others together."""
    known = F.when(F.col("value").isin("<missing>", *map(str, BEHAVIORS)), F.col("value")).otherwise("<other>")
    return counts.groupBy(known.alias("value")).agg(F.sum("n").alias("n"))


def parseable_time_range(analysed: DataFrame) -> DataFrame:
    """Over all rows whose time can be read, removed ones too."""
    return analysed.agg(F.min("parsed_time").alias("min_time"), F.max("parsed_time").alias("max_time"))
