"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.sources.schema import BEHAVIORS


# White space of Unicode, and the four separators that count as such.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Without white space, Unicode's too, at both ends; a character set, as a pattern is some ten times slower."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """A double; 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """Per cent with two decimals; null for an empty whole."""
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), 2)


def behaviour_counts(prefix: str) -> list[Column]:
    """One count of rows per behaviour, named ``prefix`` + name + ``_count``."""
    return [F.count_if(F.col("behavior_type") == code).alias(f"{prefix}{name}_count") for code, name in BEHAVIORS.items()]


def rates_to_pv(prefix: str, names: tuple[str, ...] = ("fav", "cart", "buy")) -> list[Column]:
    return [safe_rate(F.col(f"{prefix}{n}_count"), F.col(f"{prefix}pv_count")).alias(f"{prefix}{n}_to_pv_rate") for n in names]


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end).cast("double") / F.lit(3600.0)


def time_period(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def is_weekend(weekday: Column) -> Column:
    """1 for Saturday and Sunday; Monday is 0."""
    return (weekday >= 5).cast("int")


def behaviour_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in BEHAVIORS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def quantile(df: DataFrame, column: str, q: float) -> Column:
    """The exact, interpolated quantile of a column as a scalar of the plan.

    Meant for per-key totals: what it holds is one count per distinct value.
    """
    return df.agg(F.percentile(column, q)).scalar()


def quantiles(df: DataFrame, column: str, qs: tuple[float, ...]) -> list[Column]:
    """Several quantiles of a column by one aggregation."""
    every = df.agg(F.percentile(column, F.array(*map(F.lit, qs)))).scalar()
    return [F.get(every, F.lit(i)) for i in range(len(qs))]
