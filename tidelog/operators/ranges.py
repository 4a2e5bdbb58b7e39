"""Global order without one global task: rows dealt out by ranges, with prefix sums and looks ahead across their ends."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.sources import stage

#: Rows of a stretch that one window of ``leads`` runs over.
STRETCH = 100_000


def prefix_sums(df: DataFrame, order: list[Column], weight: str | None = None, name: str = "before") -> DataFrame:
    """``df`` in ``order`` with a column of what comes before each row: the number of rows, or the sum of a column ``weight``.

    The rows are sorted by ranges and stored, so that the ranges are the same for all that follows. Each range's
    sum is one row; their running sum is all that one task sees.
    """
    at, part = "__at", F.shiftright("__at", 33).alias("__part")
    placed = stage.stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    n = F.sum(weight) if weight else F.count("*")
    sums = placed.groupBy(part).agg(n.alias("__n"))
    starts = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    rows = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    if weight:
        within = Window.partitionBy("__part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(within), F.lit(0))
    else:
        inside = F.col(at).bitwiseAND((1 << 33) - 1)
    return rows.withColumn(name, F.col("__start") + inside).drop("__part", "__start", at)


def quantiles_by_rank(df: DataFrame, column: str, qs: tuple[float, ...]) -> dict[float, float | None]:
    """The exact, interpolated quantiles of a column, nulls left out; None of an empty one.

    Values are counted, the counts summed up in order, and of each quantile only the two values at its rank
    come to the driver. No task holds all distinct values, unlike ``expr.quantile``, which suits few of them.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = prefix_sums(counted, [F.col("value")], "n")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return dict.fromkeys(qs)
    ranks = {q: q * (total - 1) for q in qs}
    wanted = sorted({r for x in ranks.values() for r in (math.floor(x), math.ceil(x))})
    holds = [F.when((F.col("before") <= r) & (F.lit(r) < F.col("before") + F.col("n")), F.col("value")) for r in wanted]
    found = dict(zip(wanted, placed.agg(*(F.max(x) for x in holds)).first()))
    out = {}
    for q, x in ranks.items():
        low, high = found[math.floor(x)], found[math.ceil(x)]
        out[q] = float(low) + (float(high) - float(low)) * (x - math.floor(x))
    return out


def leads(df: DataFrame, keys: list[str], order: list[str], column: str, n: int, stretch: int = STRETCH) -> DataFrame:
    """``df`` with ``n1`` ... the values of ``column`` in the next ``n`` rows of the same key, null beyond its last.

    Rows are numbered by (keys, order) and cut into stretches of equal length, whatever their key; the first
    ``n`` rows of a stretch are seen by the one before as well. So a key with a third of all rows is as
    many stretches as it needs. Ties of the order are broken by no column: equal rows come in any order.
    """
    if stretch < n:
        raise ValueError("a stretch must hold as many rows as are looked ahead")
    numbered = prefix_sums(df, [*map(F.col, keys), *map(F.col, order)], name="__row")
    own = F.expr(f"__row div {stretch}")
    halo = (F.col("__row") % stretch < n) & (own > 0)
    seen = numbered.withColumn("__stretch", F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__stretch").orderBy("__row")
    same = lambda k: F.lead(F.struct(*keys), k).over(w).eqNullSafe(F.struct(*keys))
    ahead = seen.withColumns({f"n{k}": F.when(same(k), F.lead(column, k).over(w)) for k in range(1, n + 1)})
    return ahead.where(F.col("__stretch") == own).drop("__row", "__stretch")
