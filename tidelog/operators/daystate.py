"""Feature tables from a state that days are folded into: sums, and exact sets of ids that can be merged.

A state has two tables. ``sums`` adds up rows, behaviours and first and last time by table and key. ``sets`` holds, by
table, key and measure (``users``, ``buyers``, ``items``, ``categories``, ``days``), the ids that occurred, cut into blocks of
``BLOCK`` neighbouring numbers: a short block as a sorted array of places, a full one as a bitmap. Both are
unions: folding days in, in any order and one of them twice into ``sets``, gives the sets of all rows. A new
day costs a pass over its own rows and one over the state, never one over the log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.expr import rates_to_pv
from tidelog.sources.schema import BEHAVIORS

#: Ids of a block (what Spark's bitmap functions take), and places up to which a block is an array.
BLOCK, SHORT = 32768, 1024
_NAMES = list(BEHAVIORS.values())
#: Ids that are counted for each table: key columns, and the column of each measure (with a condition).
MEASURES: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "user": ("user_id", {"items": ("item_id", "true"), "categories": ("category_id", "true"), "days": ("day", "true")}),
    "item": ("item_id", {"users": ("user_id", "true"), "buyers": ("user_id", "buy > 0"), "days": ("day", "true")}),
    "category": ("category_id", {"users": ("user_id", "true"), "buyers": ("user_id", "buy > 0"), "items": ("item_id", "true")}),
}
SUMS = ["table", "key", "rows", *_NAMES, "first", "last"]
SETS = ["table", "key", "measure", "block", "places", "bits"]


def _sum_columns() -> list[Column]:
    return [*(F.sum(n).alias(n) for n in ("rows", *_NAMES)), F.min("first").alias("first"), F.max("last").alias("last")]


def _blocks(ids: DataFrame) -> DataFrame:
    """``sets`` rows of (table, key, measure, id) rows; equal ones are grouped first, so a hot key's block is no more than its ids."""
    block, place = F.shiftright("id", BLOCK.bit_length() - 1), F.col("id").bitwiseAND(BLOCK - 1).cast("int")
    placed = ids.select("table", "key", "measure", block.alias("block"), place.alias("place")).distinct()
    arrays = placed.groupBy("table", "key", "measure", "block").agg(F.array_sort(F.collect_list("place")).alias("places"))  # BLOCK at most
    return _settled(arrays.withColumn("bits", F.lit(None).cast("binary")))


def _settled(blocks: DataFrame) -> DataFrame:
    """Blocks with more than SHORT places, or with a bitmap, as bitmaps; all others as they are."""
    keys = ["table", "key", "measure", "block"]
    full = F.col("bits").isNotNull() | (F.size("places") > SHORT)
    own = blocks.where(full & F.col("bits").isNotNull()).select(*keys, "bits")
    made = blocks.where(full).select(*keys, F.explode("places").alias("place")).groupBy(*keys).agg(F.bitmap_construct_agg(F.col("place")).alias("bits"))
    bitmaps = own.union(made).groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"))
    none = F.lit(None)
    return blocks.where(~full).select(*SETS).union(bitmaps.select(*keys, none.cast("array<int>").alias("places"), "bits"))


def of_rows(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``sums``, ``sets``) of the cells of a day or of any part of the log (``features.cells``)."""
    x = cells.withColumn("day", F.unix_date(F.to_date("behavior_date")).cast("long"))
    sums, sets = [], []
    for table, (key, measures) in MEASURES.items():
        named = [F.lit(table).alias("table"), F.col(key).cast("long").alias("key")]
        sums.append(x.groupBy(*named).agg(*_sum_columns()))
        each = F.array(*(F.when(F.expr(when), F.struct(F.lit(m).alias("measure"), F.col(of).cast("long").alias("id"))) for m, (of, when) in measures.items()))
        sets.append(x.select(*named, F.explode(each).alias("x")).where("x IS NOT NULL").select("table", "key", "x.measure", "x.id"))
    return reduce(DataFrame.unionByName, sums), _blocks(reduce(DataFrame.unionByName, sets))


def fold(state: tuple[DataFrame, DataFrame], day: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The state with a day, or another state, in it. ``sums`` must not have had its rows before; ``sets`` may."""
    sums = state[0].unionByName(day[0]).groupBy("table", "key").agg(*_sum_columns())
    both = state[1].unionByName(day[1]).groupBy("table", "key", "measure", "block")
    # of a block there are two rows at most, so what is collected is two arrays
    merged = both.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.bitmap_or_agg("bits").alias("bits"), F.count("bits").alias("n"))
    return sums, _settled(merged.withColumn("bits", F.when(F.col("n") > 0, F.col("bits"))).select(*SETS))


def counts(sets: DataFrame) -> DataFrame:
    """(table, key, measure, n): the distinct ids of each set, exactly."""
    n = F.coalesce(F.bitmap_count("bits"), F.size("places").cast("long"))
    return sets.groupBy("table", "key", "measure").agg(F.sum(n).alias("n"))


def _with_counts(state: tuple[DataFrame, DataFrame], table: str) -> DataFrame:
    key, measures = MEASURES[table]
    only = counts(state[1].where(F.col("table") == table))
    numbers = only.groupBy("key").agg(*(F.coalesce(F.max(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).alias(m) for m in measures))
    return state[0].where(F.col("table") == table).drop("table").join(numbers, "key").withColumnRenamed("key", key)


def _totals(prefix: str) -> list[Column]:
    return [F.col("rows").alias(f"{prefix}total_count"), *(F.col(n).alias(f"{prefix}{n}_count") for n in ("pv", "fav", "cart", "buy"))]


def item_totals(state: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``features.item_features`` without the category, from the state."""
    numbers = {"users": "item_unique_user_count", "buyers": "item_unique_buyer_count"}
    base = _with_counts(state, "item").select("item_id", *_totals("item_"), *(F.col(a).alias(b) for a, b in numbers.items()), F.col("days").cast("int").alias("item_active_day_count"))
    return base.select("*", *rates_to_pv("item_"))


def category_totals(state: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``features.category_features`` from the state."""
    numbers = {"users": "category_unique_user_count", "items": "category_unique_item_count", "buyers": "category_unique_buyer_count"}
    base = _with_counts(state, "category").select("category_id", *_totals("category_"), *(F.col(a).alias(b) for a, b in numbers.items()))
    return base.select("*", *rates_to_pv("category_"))


def user_totals(state: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Totals, distinct items, categories and days, first and last time of each user, from the state."""
    numbers = {"items": "user_unique_item_count", "categories": "user_unique_category_count"}
    base = _with_counts(state, "user")
    times = [F.col("first").alias("user_first_behavior_time"), F.col("last").alias("user_last_behavior_time")]
    return base.select("user_id", *_totals("user_"), *(F.col(a).alias(b) for a, b in numbers.items()), F.col("days").cast("int").alias("user_active_day_count"), *times)
