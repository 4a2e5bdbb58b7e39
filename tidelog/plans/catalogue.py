"""The named queries of the behaviour-log engine, each beside the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import cleaning, daystate, features, marts, quality, ranges, sequences, stats
from tidelog.plans import sqltext
from tidelog.sources import files, publish, snapshot, stage
from tidelog.sources.adapters import REFERENCE, clean_events, clean_lineitem, dirty_events, raw_events
from tidelog.sources.schema import CLEAN_COLUMNS, RAW_COLUMNS
from tidelog.streaming import bursts

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

# ---- the same mapping and cleaning in DuckDB ---------------------------------------------------

_R = """r AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS "time", CAST(user_id AS VARCHAR) AS user_id,
         regexp_extract(props, '[0-9]+') AS item_id,
         CAST(1 + (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + event_id % 3) % 10 AS VARCHAR) AS item_category,
         CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2' WHEN 'signup' THEN '3' WHEN 'purchase' THEN '4' ELSE '9' END AS behavior_type
  FROM events
)"""
_D = (
    _R
    + """, d AS (
  SELECT event_id, CASE WHEN event_id % 83 = 0 THEN 'not-a-time' ELSE "time" END AS "time",
         CASE WHEN event_id % 89 = 0 THEN '  ' || user_id || ' ' ELSE user_id END AS user_id,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE item_id END AS item_id, item_category, behavior_type
  FROM r
)"""
)


def _masks(source: str) -> str:
    ok = lambda c: f"(regexp_full_match({c}, '[0-9]+') AND coalesce(TRY_CAST({c} AS BIGINT) > 0, false))"
    return f"""s AS (
  SELECT event_id, trim("time") AS st, trim(user_id) AS su, trim(item_id) AS si, trim(item_category) AS sc, trim(behavior_type) AS sb,
         "time" AS rt, user_id AS ru, item_id AS ri, item_category AS rc, behavior_type AS rb FROM {source}
), m AS (
  SELECT *, st = '' AS mt, su = '' AS mu, si = '' AS mi, sc = '' AS mc, sb = '' AS mb,
         su <> '' AND NOT {ok("su")} AS xu, si <> '' AND NOT {ok("si")} AS xi, sc <> '' AND NOT {ok("sc")} AS xc,
         sb <> '' AND sb NOT IN ('1', '2', '3', '4') AS xb,
         CASE WHEN regexp_full_match(st, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}') THEN try_strptime(st, '%Y-%m-%d %H') END AS pt
  FROM s
), a AS (
  SELECT *, CASE WHEN mt OR mu OR mi OR mc OR mb THEN 'missing_critical_field' WHEN xb THEN 'invalid_behavior_type'
                 WHEN xu OR xi OR xc THEN 'invalid_id' WHEN pt IS NULL THEN 'unparseable_time' END AS reason
  FROM m
)"""


def _clean(source: str) -> str:
    return (
        _masks(source)
        + """, c AS (
  SELECT event_id, pt AS "time", CAST(su AS BIGINT) AS user_id, CAST(si AS BIGINT) AS item_id, CAST(sc AS BIGINT) AS category_id,
         CAST(sb AS INTEGER) AS behavior_type,
         CASE sb WHEN '1' THEN 'pv' WHEN '2' THEN 'fav' WHEN '3' THEN 'cart' WHEN '4' THEN 'buy' END AS behavior_name,
         strftime(pt, '%Y-%m-%d') AS behavior_date, CAST(hour(pt) AS INTEGER) AS behavior_hour, CAST(isodow(pt) - 1 AS INTEGER) AS weekday
  FROM a WHERE reason IS NULL
)"""
    )


_WITH = {"r": f"WITH {_R}", "d": f"WITH {_D}, {_masks('d')}", "dc": f"WITH {_D}, {_clean('d')}", "c": f"WITH {_R}, {_clean('r')}"}
_WITH["l"] = """WITH c AS (
  SELECT l_shipdate + to_hours(CAST(l_orderkey % 24 AS BIGINT)) AS "time", o_custkey + 1 AS user_id, l_partkey + 1 AS item_id,
         CAST(p_size AS BIGINT) AS category_id, CAST(1 + l_linenumber % 4 AS INTEGER) AS behavior_type,
         strftime(l_shipdate + to_hours(CAST(l_orderkey % 24 AS BIGINT)), '%Y-%m-%d') AS behavior_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

_INPUT = {"r": raw_events, "d": dirty_events, "dc": dirty_events, "c": clean_events, "l": clean_lineitem}


def _query(source: str, sql: str | None, name: str | None = None):
    """Registers a function of the source's DataFrame, with the SQL over its CTE (``r``, ``d`` and ``a``, or ``c``)."""

    def add(f: Callable[[DataFrame], DataFrame]):
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: f(_INPUT[source](spark, sf_dir))
        if sql is not None:
            _ORACLES[key] = f"{_WITH[source]}\n{sql}"
        return f

    return add


def _n(p: str = "") -> str:
    return ", ".join(f"CAST(count(*) FILTER (WHERE behavior_type = {k}) AS BIGINT) AS {p}{n}_count" for k, n in ((1, "pv"), (2, "fav"), (3, "cart"), (4, "buy")))


def _rate(a: str, b: str, alias: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0::DOUBLE END AS {alias}"


def _rates(p: str, names=("fav", "cart", "buy")) -> str:
    return ", ".join(_rate(f"{p}{n}_count", f"{p}pv_count", f"{p}{n}_to_pv_rate") for n in names)


def _hours(a: str, b: str) -> str:
    return f"CAST(date_diff('second', {a}, {b}) AS DOUBLE) / 3600.0::DOUBLE"


def _pct(a: str, b: str) -> str:
    return f"round(CAST({a} AS DOUBLE) * 100.0::DOUBLE / nullif(CAST({b} AS DOUBLE), 0), 2)"


_FOUR = ("pv", "fav", "cart", "buy")
_cols = lambda p: ", ".join(f"{p}{n}_count" for n in _FOUR)

# ---- raw log -----------------------------------------------------------------------------------


@_query("r", """SELECT count(*) AS total_rows, min("time") AS min_time, max("time") AS max_time, count(DISTINCT user_id) AS users,
  count(DISTINCT item_id) AS items, count(DISTINCT item_category) AS categories, count(DISTINCT behavior_type) AS behaviors FROM r""")
def raw_overview(r):
    """Equal combinations are counted first; of these, not of raw rows, each column's values are grouped."""
    columns = {"user_id": "users", "item_id": "items", "item_category": "categories", "behavior_type": "behaviors"}
    equal = r.groupBy(*columns).agg(F.count("*").alias("n"), F.min("time").alias("low"), F.max("time").alias("high"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))).alias("x")
    values = equal.select(each, "n", "low", "high").groupBy("x.c", "x.v").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return values.agg(
        F.coalesce(F.sum(F.when(F.col("c") == "user_id", F.col("n"))), F.lit(0)).alias("total_rows"),
        F.min("low").alias("min_time"),
        F.max("high").alias("max_time"),
        *(F.count_if((F.col("c") == c) & F.col("v").isNotNull()).alias(name) for c, name in columns.items()),
    )


_COLS = ("time", "user_id", "item_id", "item_category", "behavior_type")


@_query("d", "SELECT " + ", ".join(f"""CAST(sum(CASE WHEN "{c}" IS NULL OR trim(CAST("{c}" AS VARCHAR)) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_{c}""" for c in _COLS) + " FROM d")
def raw_missing_profile(d):
    return d.agg(*(F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(f"blank_{c}") for c in _COLS))


@_query("r", """SELECT behavior_type, count(*) AS n, CASE WHEN behavior_type IN ('1', '2', '3', '4') THEN 'valid' ELSE 'invalid' END AS status
  FROM r GROUP BY behavior_type""")
def raw_behavior_codes(r):
    status = F.when(F.col("behavior_type").isin("1", "2", "3", "4"), "valid").otherwise("invalid")
    return r.groupBy("behavior_type").agg(F.count("*").alias("n")).withColumn("status", status)


@_query("d", """SELECT count(*) FILTER (WHERE regexp_full_match("time", '.{4}-.{2}-.{2} .{2}')) AS hour_format,
  count(*) FILTER (WHERE regexp_matches("time", '^[0-9]{8}')) AS eight_digits, count(*) FILTER (WHERE length("time") = 13) AS length_13,
  count(*) FILTER (WHERE length("time") = 10) AS length_10 FROM d""")
def raw_time_format_profile(d):
    t = F.col("time")
    return d.agg(
        F.count_if(t.rlike(r"^.{4}-.{2}-.{2} .{2}\z")).alias("hour_format"),
        F.count_if(t.rlike("^[0-9]{8}")).alias("eight_digits"),
        F.count_if(F.length(t) == 13).alias("length_13"),
        F.count_if(F.length(t) == 10).alias("length_10"),
    )


@_query("d", """SELECT CASE WHEN (SELECT count(*) FROM d WHERE regexp_full_match("time", '.{4}-.{2}-.{2} .{2}')) = (SELECT count(*) FROM d) THEN 'raw format'
  WHEN (SELECT count(*) FROM d WHERE regexp_matches("time", '^[0-9]{8}')) > 0 THEN 'other format' ELSE 'mixed' END AS judgement""")
def raw_status_judgement(d):
    t = F.col("time")
    hour, eight, n = F.count_if(t.rlike(r"^.{4}-.{2}-.{2} .{2}\z")), F.count_if(t.rlike("^[0-9]{8}")), F.count("*")
    return d.agg(F.when(hour == n, "raw format").when(eight > 0, "other format").otherwise("mixed").alias("judgement"))


_FLAGGED = ("behavior_date", "behavior_hour", "weekday", "behavior_name", "item_category")


_HAS = lambda c: f"coalesce(bool_or({c} <> ''), false)" if c in RAW_COLUMNS else "false"


@_query("r", "SELECT " + ", ".join(f"{_HAS(c)} AS has_{c}" for c in _FLAGGED) + ", count(*) AS rows FROM r")
def schema_feature_flags(r):
    """Which derived columns the log already has, filled in some row at least, and its rows."""
    filled = lambda c: F.coalesce(F.bool_or(F.col(c) != ""), F.lit(False)) if c in r.columns else F.lit(False)
    return r.agg(*(filled(c).alias(f"has_{c}") for c in _FLAGGED), F.count("*").alias("rows"))


_TYPE = lambda c: f"CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' ELSE lower(typeof({c})) END AS type_of_{c}"


@_query("r", f"""SELECT event_id, "time", {_TYPE("time")}, user_id, item_id, item_category, behavior_type, {_TYPE("behavior_type")}, {_TYPE("event_id")}
  FROM r ORDER BY event_id LIMIT 30""")
def raw_typed_sample(r):
    """The first rows of the log, and the types of their fields."""
    kind = lambda c: F.typeof(c).alias(f"type_of_{c}")
    rows = r.select("event_id", "time", kind("time"), "user_id", "item_id", "item_category", "behavior_type", kind("behavior_type"), kind("event_id"))
    return rows.orderBy("event_id").limit(30)


@_query("r", """SELECT event_id, "time", user_id, item_id, item_category, behavior_type, substr("time", 1, 10) AS behavior_date,
  substr("time", 12, 2) AS behavior_hour, CASE behavior_type WHEN '1' THEN 'pv' WHEN '2' THEN 'fav' WHEN '3' THEN 'cart' WHEN '4' THEN 'buy'
  ELSE 'unknown' END AS behavior_name FROM r""")
def mapped_view(r):
    return sqltext.mapped_view(r)


_AN = lambda df: cleaning.analyse(df)


@_query("dc", "SELECT event_id, " + ", ".join(f'"{c}"' for c in CLEAN_COLUMNS) + " FROM c", "clean_events")
def _clean_events(d):
    return cleaning.clean(_AN(d), keep=("event_id",))


@_query("d", "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM a GROUP BY 1")
def removal_reasons(d):
    return cleaning.removal_reasons(_AN(d))


_QC = {
    "missing_time": "mt", "missing_user_id": "mu", "missing_item_id": "mi", "missing_item_category": "mc", "missing_behavior_type": "mb",
    "missing_any": "mt OR mu OR mi OR mc OR mb", "invalid_behavior": "xb", "invalid_user_id": "xu", "invalid_item_id": "xi",
    "invalid_item_category": "xc", "invalid_id_any": "xu OR xi OR xc", "unparseable_time": "NOT mt AND pt IS NULL", "out_of_range": "false",
}


@_query("d", "SELECT count(*) AS total_rows, " + ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}" for k, v in _QC.items()) + " FROM m")
def quality_counters(d):
    return cleaning.quality_counters(_AN(d))


@_query("d", """SELECT count(DISTINCT nullif(su, '')) AS distinct_user_id, count(DISTINCT nullif(si, '')) AS distinct_item_id,
  count(DISTINCT nullif(sc, '')) AS distinct_item_category FROM s""")
def distinct_raw_ids(d):
    return cleaning.distinct_raw_ids(_AN(d))


@_query("d", """SELECT (SELECT count(*) FROM d) AS total_rows,
  (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT "time", user_id, item_id, item_category, behavior_type FROM d)) AS full_duplicates,
  (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT "time", user_id, item_id, behavior_type FROM d)) AS four_key_duplicates""")
def duplicate_diagnostics(d):
    return cleaning.duplicate_diagnostics(d)


@_query("d", "SELECT CASE WHEN sb = '' THEN '<missing>' ELSE sb END AS value, count(*) AS n FROM s GROUP BY 1")
def raw_value_counts(d):
    return cleaning.raw_value_counts(_AN(d))


@_query("d", "SELECT min(pt) AS min_time, max(pt) AS max_time FROM m")
def parseable_time_range(d):
    return cleaning.parseable_time_range(_AN(d))


@_query("d", """SELECT CASE WHEN reason IS NULL AND (pt < TIMESTAMP '2024-01-05 00:00:00' OR pt > TIMESTAMP '2024-01-20 12:00:00')
  THEN 'out_of_time_range' ELSE coalesce(reason, 'kept') END AS reason, count(*) AS n FROM a GROUP BY 1""")
def time_bound_filter(d):
    return cleaning.removal_reasons(cleaning.analyse(d, "2024-01-05 00", "2024-01-20 12"))


_B = """, b AS (SELECT date_trunc('month', "time") AS bucket, user_id, item_id, behavior_type, count(*) AS group_rows, min(event_id) AS first_position
  FROM c GROUP BY ALL HAVING count(*) >= 3)"""
_bursts = lambda c: cleaning.burst_groups(c, 3, "month")


@_query("c", _B + " SELECT CAST(bucket AS TIMESTAMP) AS bucket, user_id, item_id, behavior_type, group_rows, first_position FROM b")
def burst_groups(c):
    return _bursts(c).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@_query("c", _B + """ SELECT count(*) AS burst_groups, CAST(coalesce(sum(group_rows), 0) AS BIGINT) AS burst_rows,
  CAST(coalesce(sum(group_rows - 1), 0) AS BIGINT) AS removable_rows, coalesce(max(group_rows), 0) AS max_group_rows FROM b""")
def burst_summary(c):
    return cleaning.burst_summary(_bursts(c))


@_query("c", _B + " SELECT behavior_type, count(*) AS burst_groups, CAST(sum(group_rows) AS BIGINT) AS burst_rows FROM b GROUP BY 1")
def burst_by_behavior(c):
    return _bursts(c).groupBy("behavior_type").agg(F.count("*").alias("burst_groups"), F.sum("group_rows").alias("burst_rows"))


@_query("c", """SELECT event_id, "time", user_id, item_id, category_id, behavior_type FROM c
  WINDOW w AS (PARTITION BY date_trunc('month', "time"), user_id, item_id, behavior_type)
  QUALIFY count(*) OVER w < 3 OR row_number() OVER (PARTITION BY date_trunc('month', "time"), user_id, item_id, behavior_type ORDER BY event_id) = 1""")
def burst_collapse(c):
    return cleaning.collapse_bursts(c, 3, "month").select("event_id", "time", "user_id", "item_id", "category_id", "behavior_type")


# ---- statistics --------------------------------------------------------------------------------

_DIST = f"""SELECT behavior_name, count(*) AS behavior_count, {_pct("count(*)", "sum(count(*)) OVER ()")} AS percentage
  FROM c WHERE behavior_name IN ('pv', 'fav', 'cart', 'buy') GROUP BY behavior_name"""
_query("c", _DIST, "behavior_distribution")(stats.behavior_distribution)
_query("c", _DIST, "behavior_distribution_sql")(sqltext.behavior_distribution)

_BSTAT = """SELECT count(DISTINCT user_id) AS total_users, count(*) FILTER (WHERE behavior_type = 4) AS total_purchases,
  count(DISTINCT CASE WHEN behavior_type = 4 THEN user_id END) AS buyers,
  count(DISTINCT user_id) - count(DISTINCT CASE WHEN behavior_type = 4 THEN user_id END) AS non_buyers,
  (SELECT count(*) FROM (SELECT user_id FROM c WHERE behavior_type = 4 GROUP BY user_id HAVING count(*) >= 2)) AS repeat_buyers FROM c"""
_query("c", _BSTAT, "behavior_statistics")(stats.behavior_statistics)
_query("c", _BSTAT, "behavior_statistics_sql")(sqltext.behavior_statistics)


@_query("c", """SELECT DISTINCT user_id FROM c WHERE user_id IN
  (SELECT user_id FROM c WHERE behavior_type = 4 GROUP BY user_id HAVING count(*) >= 2)""")
def repeat_buyers_semijoin(c):
    repeat = c.where("behavior_type = 4").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2")
    return c.select("user_id").distinct().join(repeat, "user_id", "left_semi")


@_query("c", "SELECT DISTINCT user_id FROM c WHERE user_id NOT IN (SELECT user_id FROM c WHERE behavior_type = 4)")
def non_buyers_antijoin(c):
    return c.select("user_id").distinct().join(c.where("behavior_type = 4").select("user_id"), "user_id", "left_anti")


@_query("c", """SELECT DISTINCT user_id, item_id FROM c WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM c WHERE behavior_type = 4)""")
def unbought_pairs_antijoin(c):
    """Pairs of user and item without a purchase."""
    return c.select("user_id", "item_id").distinct().join(c.where("behavior_type = 4").select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


_ITEMS = f"SELECT item_id, {_n()} FROM c GROUP BY item_id"
_query("c", _ITEMS, "item_statistics")(stats.item_statistics)
_query("c", _ITEMS, "item_statistics_pivot")(stats.item_statistics_pivot)
_TOPI = lambda n: f"SELECT * FROM ({_ITEMS}) ORDER BY buy_count DESC, item_id LIMIT {n}"
_CATS = f"""SELECT category_id, count(*) AS total_count, count(*) FILTER (WHERE behavior_type = 4) AS buy_count,
  {_pct("count(*) FILTER (WHERE behavior_type = 4)", "sum(count(*) FILTER (WHERE behavior_type = 4)) OVER ()")} AS buy_share FROM c GROUP BY category_id"""
_query("c", _CATS, "category_statistics")(stats.category_statistics)
_TOPC = lambda n: f"SELECT * FROM ({_CATS}) ORDER BY buy_count DESC, category_id LIMIT {n}"
for _name, _k in (("top_items", 10), ("top20_items", 20), ("top5_items", 5)):
    _query("c", _TOPI(_k), _name)(lambda c, k=_k: stats.top(stats.item_statistics(c), "buy_count", "item_id", k))
for _name, _k in (("top_categories", 10), ("top20_categories", 20), ("top5_categories", 5)):
    _query("c", _TOPC(_k), _name)(lambda c, k=_k: stats.top(stats.category_statistics(c), "buy_count", "category_id", k))
_query("c", "SELECT behavior_date, count(*) AS behavior_count FROM c GROUP BY 1", "daily_behavior")(stats.daily_behavior)
_query("c", "SELECT behavior_hour, count(*) AS behavior_count FROM c GROUP BY 1", "hourly_behavior")(stats.hourly_behavior)
_query("c", "SELECT behavior_hour, " + ", ".join(f"count(*) FILTER (WHERE behavior_name = '{n}') AS {n}" for n in _FOUR) + " FROM c GROUP BY 1", "hourly_pivot")(stats.hourly_pivot)
_FUNNEL = " UNION ALL ".join(
    f"""SELECT '{n}' AS stage, count(*) FILTER (WHERE behavior_name = '{n}') AS behavior_count,
  {_pct(f"count(*) FILTER (WHERE behavior_name = '{n}')", "count(*) FILTER (WHERE behavior_name = 'pv')")} AS pct_of_pv FROM c"""
    for n in _FOUR
)
_query("c", _FUNNEL, "descriptive_funnel")(stats.descriptive_funnel)
_query("c", _FUNNEL, "descriptive_funnel_sql")(sqltext.descriptive_funnel)
_PAIRS = (("pv", "fav"), ("pv", "cart"), ("pv", "buy"), ("fav", "buy"), ("cart", "buy"))
_CONV = f", k AS (SELECT {_n()} FROM c)"
_query("c", _CONV + " SELECT *, " + ", ".join(_rate(f"{b}_count", f"{a}_count", f"{a}_to_{b}_rate") for a, b in _PAIRS) + " FROM k", "conversion_features")(stats.conversion_features)
_query(
    "c",
    _CONV + " " + " UNION ALL ".join(f"SELECT '{a}_to_{b}_rate' AS metric, {_rate(f'{b}_count', f'{a}_count', 'rate')} FROM k" for a, b in _PAIRS),
    "conversion_rates_unpivot",
)(stats.conversion_rates_unpivot)

# ---- feature tables ----------------------------------------------------------------------------


def _user_sql(ref: str) -> str:
    return f""", u AS (
  SELECT user_id, count(*) AS user_total_count, {_n("user_")}, count(DISTINCT item_id) AS user_unique_item_count,
         count(DISTINCT category_id) AS user_unique_category_count, CAST(count(DISTINCT behavior_date) AS INTEGER) AS user_active_day_count,
         min("time") AS user_first_behavior_time, max("time") AS user_last_behavior_time FROM c GROUP BY user_id
), uf AS (
  SELECT user_id, user_total_count, {_cols("user_")}, user_unique_item_count, user_unique_category_count, user_active_day_count,
         CAST(user_total_count AS DOUBLE) / CAST(user_active_day_count AS DOUBLE) AS user_avg_daily_behavior_count,
         CASE WHEN user_total_count >= (SELECT median(user_total_count) FROM u) THEN 'high' ELSE 'low' END AS user_activity_level,
         {_hours("user_first_behavior_time", "user_last_behavior_time")} AS user_behavior_span_hours, user_first_behavior_time, user_last_behavior_time,
         {_hours("user_last_behavior_time", f"TIMESTAMP '{ref}'")} AS user_recency_hours, {_rates("user_")},
         CAST(user_buy_count >= 1 AS INTEGER) AS user_is_buyer, CAST(user_buy_count >= 2 AS INTEGER) AS user_is_repeat_buyer FROM u
)"""


_CANON = """canon AS (
  SELECT item_id, category_id FROM (SELECT item_id, category_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, category_id) AS k
    FROM c GROUP BY item_id, category_id) WHERE k = 1
)"""
_ITEM = f""", {_CANON}, i AS (
  SELECT item_id, count(*) AS item_total_count, {_n("item_")}, count(DISTINCT user_id) AS item_unique_user_count,
         count(DISTINCT CASE WHEN behavior_type = 4 THEN user_id END) AS item_unique_buyer_count,
         CAST(count(DISTINCT behavior_date) AS INTEGER) AS item_active_day_count FROM c GROUP BY item_id
), itf AS (
  SELECT item_id, category_id, item_total_count, {_cols("item_")}, item_unique_user_count, item_unique_buyer_count, item_active_day_count,
         {_rates("item_")} FROM i LEFT JOIN canon USING (item_id)
)"""
_CAT = f""", g AS (
  SELECT category_id, count(*) AS category_total_count, {_n("category_")}, count(DISTINCT user_id) AS category_unique_user_count,
         count(DISTINCT item_id) AS category_unique_item_count, count(DISTINCT CASE WHEN behavior_type = 4 THEN user_id END) AS category_unique_buyer_count
  FROM c GROUP BY category_id
), cf AS (SELECT *, {_rates("category_")} FROM g)"""
_TIME = f""", t AS (
  SELECT CAST(behavior_date AS DATE) AS behavior_date, behavior_hour, min(weekday) AS weekday, count(*) AS time_total_count, {_n("time_")},
         count(DISTINCT user_id) AS time_unique_user_count, count(DISTINCT item_id) AS time_unique_item_count FROM c GROUP BY 1, 2
), tf AS (
  SELECT behavior_date, behavior_hour, weekday, CAST(weekday >= 5 AS INTEGER) AS is_weekend,
         CASE WHEN behavior_hour < 6 THEN 'night' WHEN behavior_hour < 12 THEN 'morning' WHEN behavior_hour < 18 THEN 'afternoon' ELSE 'evening' END AS time_period,
         time_total_count, {_cols("time_")}, time_unique_user_count, time_unique_item_count, {_rates("time_", ("buy",))} FROM t
)"""
_UI = f""", ui AS (
  SELECT user_id, item_id, {_n("ui_")}, max("time") AS ui_last_interaction_time, CAST(max("time") AS DATE) AS ui_last_interaction_date,
         CAST(hour(max("time")) AS INTEGER) AS ui_last_interaction_hour, CAST(count(*) FILTER (WHERE behavior_type = 4) > 0 AS INTEGER) AS ui_has_bought
  FROM c GROUP BY user_id, item_id
)"""
_ICONV = f""", ic AS (SELECT item_id, {_rate("buy", "pv", "item_pv_to_buy_rate")}, {_rate("cart", "pv", "item_pv_to_cart_rate")},
  {_rate("buy", "cart", "item_cart_to_buy_rate")}, {_rate("buy", "fav", "item_fav_to_buy_rate")} FROM (
  SELECT item_id, {", ".join(f"count(*) FILTER (WHERE behavior_type = {k}) AS {n}" for k, n in ((1, "pv"), (2, "fav"), (3, "cart"), (4, "buy")))} FROM c GROUP BY item_id))"""

_users = lambda c: features.user_features(c, REFERENCE)
_log = lambda c: stage.stored(c.select(*CLEAN_COLUMNS), "log")  # noqa: E731  # read and cleaned once for what reads it several times
_cells = lambda c: stage.stored(features.cells(c), "cells")
_query("c", _user_sql(REFERENCE) + " SELECT * FROM uf", "user_features")(lambda c: _users(_cells(c)))
_query("c", _ITEM + " SELECT * FROM itf", "item_features")(lambda c: features.item_features(_cells(c)))
_query("c", _CAT + " SELECT * FROM cf", "category_features")(lambda c: features.category_features(_cells(c)))
_query("c", _TIME + " SELECT * FROM tf", "time_features")(lambda c: features.time_features(_cells(c)))
_query("c", _UI + " SELECT * FROM ui", "user_item_features")(features.user_item_features)
_query("c", f", {_CANON} SELECT * FROM canon", "canonical_item_category")(features.canonical_item_category)
_query("c", _user_sql(REFERENCE) + " SELECT user_id, user_total_count, user_activity_level FROM uf", "user_activity_median")(
    lambda c: _users(_cells(c)).select("user_id", "user_total_count", "user_activity_level")
)
_query(
    "c",
    f""", u AS (SELECT user_id, count(*) AS n, count(DISTINCT behavior_date) AS active_days, max("time") AS last_active_time, min("time") AS f FROM c GROUP BY user_id)
  SELECT user_id, active_days, round(CAST(n AS DOUBLE) / CAST(active_days AS DOUBLE), 2) AS avg_daily_behavior, last_active_time,
    round({_hours("f", "last_active_time")} / 24.0::DOUBLE, 2) AS behavior_span_days,
    CASE WHEN n >= (SELECT quantile_cont(n, 0.8) FROM u) THEN 'High' WHEN n < (SELECT quantile_cont(n, 0.2) FROM u) THEN 'Low' ELSE 'Medium' END AS activity_level FROM u""",
    "user_activity_p20_p80",
)(features.user_activity_p20_p80)
_TS = lambda dim, val: f"SELECT '{dim}' AS time_dimension, CAST({val} AS VARCHAR) AS time_value, count(*) AS behavior_count, {_n()} FROM c GROUP BY 2"
_query(
    "c",
    " UNION ALL ".join(
        (
            _TS("hour", "behavior_hour"),
            _TS("weekday", "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][weekday + 1]"),
            _TS("day_type", "CASE WHEN weekday >= 5 THEN 'weekend' ELSE 'weekday' END"),
        )
    ),
    "time_summary",
)(stats.time_summary)
_query(
    "c",
    f""", h AS (SELECT behavior_hour, count(*) AS behavior_count, {_n()} FROM c GROUP BY 1)
  SELECT CASE WHEN behavior_count >= (SELECT quantile_cont(behavior_count, 0.8) FROM h) THEN 'Peak' ELSE 'Non-Peak' END AS hour_type,
    string_agg(CAST(behavior_hour AS VARCHAR), '|' ORDER BY behavior_hour) AS hours, CAST(sum(behavior_count) AS BIGINT) AS behavior_count,
    {", ".join(f"CAST(sum({n}_count) AS BIGINT) AS {n}_count" for n in _FOUR)} FROM h GROUP BY 1""",
    "peak_hours",
)(stats.peak_hours)

# ---- sequences ---------------------------------------------------------------------------------

_RANK = """, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "time" DESC, item_id DESC, behavior_type DESC) AS rn FROM c)"""
_R10 = _RANK + """, s10 AS (SELECT user_id, array_to_string(list(behavior_type ORDER BY rn DESC), ',') AS sequence_recent_10_behavior_types FROM k WHERE rn <= 10 GROUP BY user_id)"""
_GAP = f""", gp AS (SELECT user_id, CASE WHEN count(*) > 1 THEN {_hours('min("time")', 'max("time")')} / CAST(count(*) - 1 AS DOUBLE) ELSE 0.0::DOUBLE END
  AS sequence_avg_behavior_gap_hours FROM c GROUP BY user_id)"""
_CHAIN = """, p1 AS (SELECT *, max(CASE WHEN behavior_type = 1 THEN 1 ELSE 0 END) OVER w AS pv FROM c
  WINDOW w AS (PARTITION BY user_id, item_id ORDER BY "time", behavior_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), p2 AS (SELECT *, max(CASE WHEN behavior_type = 3 AND pv = 1 THEN 1 ELSE 0 END) OVER w AS pc FROM p1
  WINDOW w AS (PARTITION BY user_id, item_id ORDER BY "time", behavior_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), ch AS (SELECT user_id, max(CASE WHEN behavior_type = 3 AND pv = 1 THEN 1 ELSE 0 END) AS sequence_has_pv_cart,
  max(CASE WHEN behavior_type = 2 AND pv = 1 THEN 1 ELSE 0 END) AS sequence_has_pv_fav,
  max(CASE WHEN behavior_type = 4 AND pv = 1 THEN 1 ELSE 0 END) AS sequence_has_pv_buy,
  max(CASE WHEN behavior_type = 4 AND pc = 1 THEN 1 ELSE 0 END) AS sequence_has_pv_cart_buy FROM p2 GROUP BY user_id)"""
_SEQ = _R10 + _GAP + _CHAIN + ", sq AS (SELECT * FROM s10 FULL JOIN gp USING (user_id) FULL JOIN ch USING (user_id))"
_text = lambda df: df.withColumn("sequence_recent_10_behavior_types", F.array_join(F.col("sequence_recent_10_behavior_types").cast("array<string>"), ","))
_query("c", _R10 + " SELECT * FROM s10", "recent_10")(lambda c: _text(sequences.recent_10(c)))
_query("c", _GAP + " SELECT * FROM gp", "avg_gap_hours")(sequences.avg_gap_hours)
_query("c", _CHAIN + " SELECT * FROM ch", "chain_flags")(sequences.chain_flags)
_query("c", _CHAIN + " SELECT * FROM ch", "chain_flags_windowed")(sequences.chain_flags_windowed)
_query("c", _SEQ + " SELECT * FROM sq", "sequence_features")(lambda c: _text(sequences.sequence_features(_log(c))))
_A5 = "string_agg(behavior_name, '|' ORDER BY rn DESC) AS recent_5_actions"
_I5 = """CASE WHEN count(*) > 1 THEN round(CAST(date_diff('second', min("time"), max("time")) AS DOUBLE) / 60.0::DOUBLE / CAST(count(*) - 1 AS DOUBLE), 2)
  ELSE 0.0::DOUBLE END AS avg_recent_5_interval_min"""
_LEAD = """, ld AS (SELECT *, lead(behavior_name, 1) OVER w AS n1, lead(behavior_name, 2) OVER w AS n2, lead(behavior_name, 3) OVER w AS n3 FROM c
  WINDOW w AS (PARTITION BY user_id, item_id ORDER BY "time", behavior_type))"""
_TRANS = ", ".join(f"count(*) FILTER (WHERE behavior_name = 'pv' AND n1 = '{n}') AS pv_to_{n}_count" for n in ("fav", "cart", "buy"))
_ADJ = """max(CASE WHEN behavior_name = 'pv' AND ((n1 IN ('fav', 'cart') AND n2 = 'buy') OR (n1 = 'fav' AND n2 = 'cart' AND n3 = 'buy')) THEN 1 ELSE 0 END) AS has_behavior_chain"""
_query("c", _RANK + f" SELECT user_id, {_A5} FROM k WHERE rn <= 5 GROUP BY user_id", "recent_5_actions")(sequences.recent_5_actions)
_query("c", _RANK + f" SELECT user_id, {_I5} FROM k WHERE rn <= 5 GROUP BY user_id", "recent_5_interval")(sequences.recent_5_interval)
_query("c", _LEAD + f" SELECT user_id, {_TRANS} FROM ld GROUP BY user_id", "adjacent_transitions")(sequences.adjacent_transitions)
_query("c", _LEAD + f" SELECT user_id, {_ADJ} FROM ld GROUP BY user_id", "adjacent_chains")(sequences.adjacent_chains)
_query(
    "c",
    _RANK + _LEAD + f""" SELECT * FROM (SELECT user_id, {_A5}, {_I5} FROM k WHERE rn <= 5 GROUP BY user_id)
  LEFT JOIN (SELECT user_id, {_TRANS}, {_ADJ} FROM ld GROUP BY user_id) USING (user_id)""",
    "recent_path_features",
)(lambda c: sequences.recent_path_features(_log(c)))

# ---- tiers, marts and the wide table -----------------------------------------------------------


def _heat_sql(table: str, key: str, total: str, low: str, mid: str, high: str) -> str:
    return f""" SELECT {key}, {total} AS total_count, CASE WHEN {total} < (SELECT quantile_cont({total}, 0.25) FROM {table}) THEN '{low}'
  WHEN {total} >= (SELECT quantile_cont({total}, 0.75) FROM {table}) THEN '{high}' ELSE '{mid}' END AS heat FROM {table}"""


_query("c", _ITEM + _heat_sql("itf", "item_id", "item_total_count", "low", "medium", "high"), "item_heat")(
    lambda c: features.heat(stage.stored(features.item_features(_cells(c)), "features"), "item_id", "item_total_count", ("low", "medium", "high"))
)
_query("c", _CAT + _heat_sql("cf", "category_id", "category_total_count", "long_tail", "medium", "popular"), "category_heat")(
    lambda c: features.heat(stage.stored(features.category_features(_cells(c)), "features"), "category_id", "category_total_count", ("long_tail", "medium", "popular"))
)
_SEG = _CAT + """, sg AS (SELECT category_id, category_total_count, category_buy_count, category_buy_to_pv_rate,
  CASE WHEN category_total_count >= (SELECT quantile_cont(category_total_count, 0.8) FROM cf) THEN 'hot'
       WHEN category_total_count <= (SELECT quantile_cont(category_total_count, 0.2) FROM cf) THEN 'long_tail' ELSE 'normal' END AS segment FROM cf)"""
_segments = lambda c: marts.category_segments(features.category_features(c))
_query("c", _SEG + " SELECT * FROM sg", "category_segments")(_segments)
_query(
    "c",
    _SEG + """ SELECT segment, count(*) AS categories, CAST(sum(category_total_count) AS BIGINT) AS total_count,
  CAST(sum(category_buy_count) AS BIGINT) AS buy_count, round(avg(category_buy_to_pv_rate), 6) AS avg_buy_rate FROM sg GROUP BY segment""",
    "segment_summary",
)(lambda c: marts.segment_summary(_segments(c)))


def _wide(c):
    log = stage.bucketed(c.select(*CLEAN_COLUMNS), "log", ["user_id"])
    cells = stage.bucketed(features.cells(log), "cells", ["user_id"])
    found = stage.bucketed(sequences.sequence_features(log), "sequences", ["user_id"])
    return _text(features.wide_user_item(cells, REFERENCE, found))


def _kpis(x):
    return marts.kpis(stage.stored(_users(x), "users"), x.select("item_id").distinct(), x.select("category_id").distinct())


def _user_sets(c):
    log = _log(c)
    return quality.user_set_equality(_users(_cells(log)), sequences.avg_gap_hours(log))


_query("c", _ICONV + " SELECT * FROM ic", "item_conversion_features")(features.item_conversion_features)
_query(
    "c",
    _user_sql(REFERENCE) + _ITEM + _CAT + _TIME + _UI + _ICONV + _SEQ
    + """ SELECT * FROM ui LEFT JOIN uf USING (user_id) LEFT JOIN sq USING (user_id) LEFT JOIN itf USING (item_id) LEFT JOIN ic USING (item_id)
  LEFT JOIN cf USING (category_id) LEFT JOIN (SELECT behavior_date AS ui_last_interaction_date, behavior_hour AS ui_last_interaction_hour, weekday,
    is_weekend, time_period, time_total_count, time_buy_to_pv_rate FROM tf) USING (ui_last_interaction_date, ui_last_interaction_hour)""",
    "wide_user_item",
)(_wide)
_query("c", _ITEM + " SELECT item_id, item_total_count, item_pv_count, item_buy_count, item_buy_to_pv_rate FROM itf", "item_mart")(
    lambda c: marts.item_mart(features.item_features(c))
)
_query("c", _CAT + " SELECT category_id, category_total_count, category_pv_count, category_buy_count, category_buy_to_pv_rate FROM cf", "category_mart")(
    lambda c: marts.category_mart(features.category_features(c))
)
_query(
    "c",
    _user_sql(REFERENCE) + """ SELECT user_id, user_total_count, user_active_day_count, user_unique_item_count, user_unique_category_count,
  user_activity_level, user_is_buyer FROM uf""",
    "user_depth_mart",
)(lambda c: marts.user_depth_mart(_users(_cells(c))))
_query(
    "c",
    _user_sql(REFERENCE) + f""", k AS (SELECT count(*) AS users, CAST(sum(user_is_buyer) AS BIGINT) AS buyers, CAST(sum(user_total_count) AS BIGINT) AS behaviors,
  CAST(sum(user_pv_count) AS BIGINT) AS pv, CAST(sum(user_buy_count) AS BIGINT) AS buys FROM uf)
  SELECT *, (SELECT count(DISTINCT item_id) FROM c) AS items, (SELECT count(DISTINCT category_id) FROM c) AS categories, {_rate("buys", "pv", "buy_rate")} FROM k""",
    "kpis",
)(lambda c: _kpis(_cells(c)))
_query(
    "c",
    _ITEM + """ SELECT item_id, item_total_count, item_pv_count, item_buy_to_pv_rate FROM itf WHERE item_pv_count >= 5 AND item_total_count > 0
  ORDER BY item_total_count DESC, item_id LIMIT 5000""",
    "item_scatter",
)(lambda c: marts.item_scatter(features.item_features(c)))
_query(
    "c",
    _CAT + """ SELECT category_id, category_total_count, category_pv_count, category_buy_to_pv_rate FROM cf WHERE category_pv_count > 0
  ORDER BY category_total_count DESC, category_id LIMIT 3000""",
    "category_scatter",
)(lambda c: marts.category_scatter(features.category_features(c)))

# ---- checks ------------------------------------------------------------------------------------

_ALL = _user_sql(REFERENCE) + _ITEM + _CAT + _TIME + _UI
_SQLNAMES = {"user_features": "uf", "item_features": "itf", "category_features": "cf", "time_features": "tf", "user_item_features": "ui"}
_TOTALS = {
    "user_features": "user_total_count",
    "item_features": "item_total_count",
    "category_features": "category_total_count",
    "time_features": "time_total_count",
    "user_item_features": "ui_pv_count + ui_fav_count + ui_cart_count + ui_buy_count",
}


def _tables(c: DataFrame) -> dict[str, DataFrame]:
    return {
        "user_features": _users(c),
        "item_features": features.item_features(c),
        "category_features": features.category_features(c),
        "time_features": features.time_features(c),
        "user_item_features": features.user_item_features(c),
    }


_query(
    "c",
    _ALL + " " + " UNION ALL ".join(
        f"SELECT '{k}' AS table_name, CAST(sum({_TOTALS[k]}) AS BIGINT) AS total_count, (SELECT count(*) FROM c) AS clean_rows, sum({_TOTALS[k]}) = (SELECT count(*) FROM c) AS matches FROM {v}"
        for k, v in _SQLNAMES.items()
    ),
    "feature_reconciliation",
)(lambda c: quality.reconciliation({k: (df, F.expr(_TOTALS[k])) for k, df in _tables(_cells(c)).items()}, c))
_query(
    "c",
    _ALL + " " + " UNION ALL ".join(
        f"SELECT '{k}' AS table_name, count(*) AS row_count, count(*) FILTER (WHERE {' OR '.join(x + ' IS NULL' for x in quality.KEYS[k])}) AS null_keys, count(*) - count(DISTINCT ({', '.join(quality.KEYS[k])})) AS duplicate_keys FROM {v}"
        for k, v in _SQLNAMES.items()
    ),
    "pk_checks",
)(lambda c: quality.pk_checks(_tables(_cells(c))))


def _rules(c):
    log = _log(c)
    x, found = _cells(log), stage.stored(sequences.sequence_features(log), "sequences")
    return quality.feature_qa_rules({"user_features": _users(x), "time_features": features.time_features(x), "sequence_features": found})


_SUM = lambda p: " + ".join(f"{p}{n}_count" for n in _FOUR)
_LIST = "string_split(sequence_recent_10_behavior_types, ',')"
_RULES = {
    "uf": {
        "user_id_present": "user_id IS NOT NULL", "user_total_positive": "user_total_count > 0", "user_average_not_negative": "user_avg_daily_behavior_count >= 0",
        "user_counts_add_up": f"{_SUM('user_')} = user_total_count", "user_active_days_positive": "user_active_day_count >= 1",
        "user_span_not_negative": "user_behavior_span_hours >= 0", "user_recency_not_negative": "user_recency_hours >= 0",
        "user_level_known": "user_activity_level IN ('high', 'low')", "user_rates_not_negative": "least(user_fav_to_pv_rate, user_cart_to_pv_rate, user_buy_to_pv_rate) >= 0",
        "user_buyer_flag": "user_is_buyer IN (0, 1)", "user_repeat_flag": "user_is_repeat_buyer IN (0, 1)", "user_repeat_implies_buyer": "user_is_repeat_buyer <= user_is_buyer",
    },
    "tf": {
        "time_hour_in_range": "behavior_hour BETWEEN 0 AND 23", "time_weekday_in_range": "weekday BETWEEN 0 AND 6", "time_weekend_flag": "is_weekend IN (0, 1)",
        "time_weekend_agrees": "is_weekend = CAST(weekday >= 5 AS INTEGER)", "time_period_known": "time_period IN ('night', 'morning', 'afternoon', 'evening')",
        "time_counts_add_up": f"{_SUM('time_')} = time_total_count",
    },
    "sq": {
        "sequence_user_present": "user_id IS NOT NULL", "sequence_length": f"len({_LIST}) BETWEEN 1 AND 10",
        "sequence_codes": f"len([x FOR x IN {_LIST} IF x NOT IN ('1', '2', '3', '4')]) = 0", "sequence_gap_not_negative": "sequence_avg_behavior_gap_hours >= 0",
        **{f"sequence_{f}_flag": f"sequence_has_{f} IN (0, 1)" for f in ("pv_cart", "pv_fav", "pv_buy", "pv_cart_buy")},
        "sequence_chain_implies_steps": "sequence_has_pv_cart_buy <= least(sequence_has_pv_cart, sequence_has_pv_buy)",
    },
}
_KEYED = {"user_features": ("uf", "user_id"), "time_features": ("tf", "behavior_date, behavior_hour"), "sequence_features": ("sq", "user_id")}
_CHECKS = [f"SELECT '{k}' AS rule, count(*) FILTER (WHERE NOT coalesce({v}, false)) AS failures FROM {t}" for t, rules in _RULES.items() for k, v in rules.items()]
_CHECKS += [f"SELECT '{n}_duplicate_keys', count(*) - count(DISTINCT ({k})) FROM {t}" for n, (t, k) in _KEYED.items()]
_CHECKS += [f"SELECT '{n}_null_keys', count(*) FILTER (WHERE {' OR '.join(f'{x} IS NULL' for x in k.split(', '))}) FROM {t}" for n, (t, k) in _KEYED.items()]
_CHECKS += [
    "SELECT 'same_user_count', abs((SELECT count(DISTINCT user_id) FROM uf) - (SELECT count(DISTINCT user_id) FROM sq))",
    "SELECT 'same_user_set', count(*) FROM (SELECT DISTINCT user_id FROM uf) a FULL JOIN (SELECT DISTINCT user_id FROM sq) b USING (user_id) WHERE a.user_id IS NULL OR b.user_id IS NULL",
]
_query(
    "c",
    _user_sql(REFERENCE) + _TIME + _SEQ + " SELECT rule, failures, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + " UNION ALL ".join(_CHECKS) + ")",
    "feature_qa_rules",
)(_rules)
_query(
    "c",
    _SEQ + """ SELECT count(*) AS row_count, count(*) - count(DISTINCT user_id) AS duplicate_users,
  count(*) FILTER (WHERE NOT regexp_full_match(sequence_recent_10_behavior_types, '[1-4](,[1-4]){0,9}')) AS bad_sequences,
  count(*) FILTER (WHERE sequence_has_pv_cart NOT IN (0, 1) OR sequence_has_pv_fav NOT IN (0, 1) OR sequence_has_pv_buy NOT IN (0, 1) OR sequence_has_pv_cart_buy NOT IN (0, 1)) AS bad_flags FROM sq""",
    "sequence_validation",
)(
    lambda c: sequences.sequence_features(c).agg(
        F.count("*").alias("row_count"),
        (F.count("*") - F.countDistinct("user_id")).alias("duplicate_users"),
        F.count_if(
            ~(F.size("sequence_recent_10_behavior_types").between(1, 10) & F.forall("sequence_recent_10_behavior_types", lambda x: x.isin(1, 2, 3, 4)))
        ).alias("bad_sequences"),
        F.count_if(
            ~(
                F.col("sequence_has_pv_cart").isin(0, 1)
                & F.col("sequence_has_pv_fav").isin(0, 1)
                & F.col("sequence_has_pv_buy").isin(0, 1)
                & F.col("sequence_has_pv_cart_buy").isin(0, 1)
            )
        ).alias("bad_flags"),
    )
)
_query(
    "c",
    _user_sql(REFERENCE) + _SEQ + """, l AS (SELECT (SELECT count(*) FROM (SELECT user_id FROM uf EXCEPT SELECT user_id FROM sq)) AS only_left,
  (SELECT count(*) FROM (SELECT user_id FROM sq EXCEPT SELECT user_id FROM uf)) AS only_right)
  SELECT *, only_left = 0 AND only_right = 0 AS equal FROM l""",
    "user_set_equality",
)(_user_sets)
_query("c", _user_sql(REFERENCE) + " SELECT user_activity_level, count(*) AS users FROM uf GROUP BY 1", "tier_distribution")(
    lambda c: _users(_cells(c)).groupBy("user_activity_level").agg(F.count("*").alias("users"))
)
_SPREAD_SQL = {"user_features": "uf", "time_features": "tf", "sequence_features": "sq"}
_query(
    "c",
    _user_sql(REFERENCE) + _TIME + _SEQ + " " + " UNION ALL ".join(
        f"SELECT '{x}' AS feature, CAST({x} AS VARCHAR) AS value, count(*) AS n FROM {t} GROUP BY 2" for k, t in _SPREAD_SQL.items() for x in quality.SPREAD[k]
    ),
    "feature_distributions",
)(lambda c: _spread(_log(c)))


def _spread(log):
    x = _cells(log)
    return quality.distributions({"user_features": _users(x), "time_features": features.time_features(x), "sequence_features": sequences.sequence_features(log)})


_FLAGS = ("pv_cart", "pv_fav", "pv_buy", "pv_cart_buy")
_query("c", _CHAIN + " SELECT " + ", ".join(f"CAST(sum(sequence_has_{f}) AS BIGINT) AS users_{f}" for f in _FLAGS) + " FROM ch", "chain_user_counts")(
    lambda c: sequences.chain_flags(c).agg(*(F.sum(f"sequence_has_{f}").alias(f"users_{f}") for f in _FLAGS))
)

# ---- larger volume -----------------------------------------------------------------------------

_LREF = "2003-01-01 00:00:00"
_query("l", _user_sql(_LREF) + " SELECT * FROM uf", "user_features_lineitem")(lambda c: features.user_features(_cells(c), _LREF))
_query("l", _ITEM + " SELECT * FROM itf", "item_features_lineitem")(lambda c: features.item_features(_cells(c)))


# ---- layouts and states ------------------------------------------------------------------------

_WINDOW = ("2024-01-05 03:00:00", "2024-01-20 12:00:00")


@_query("c", f"""SELECT behavior_date, count(*) AS behavior_count, count(DISTINCT user_id) AS users FROM c
  WHERE "time" BETWEEN TIMESTAMP '{_WINDOW[0]}' AND TIMESTAMP '{_WINDOW[1]}' GROUP BY 1""")
def dated_log_window(c):
    """The log written with a folder for each day, then a window of it, of which only its days are read."""
    path = stage.path_for(c.sparkSession, "dated")
    publish.dated_form("behavior_date", ["time", "user_id"]).write(c.select(*CLEAN_COLUMNS), path)
    log = files.read_clean(c.sparkSession, path, ["behavior_date", "user_id"], *_WINDOW)
    by_user = log.groupBy("behavior_date", "user_id").agg(F.count("*").alias("n"))
    return by_user.groupBy("behavior_date").agg(F.sum("n").alias("behavior_count"), F.count("*").alias("users"))


def _folded(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state of the log, of which three parts by date come one after the other, the second one twice into the sets."""
    x = _cells(c)
    put = lambda state: tuple(stage.stored(df, name) for df, name in zip(state, ("sums", "sets")))
    part = F.pmod(F.unix_date(F.to_date("behavior_date")), F.lit(3))
    state = put(daystate.of_rows(x.where(part == 0)))
    for k in (1, 2):
        day = put(daystate.of_rows(x.where(part == k)))
        folded = put(daystate.fold(state, day))
        stage.release(*state, *day)
        state = folded
    return state


_query("c", _ITEM + " SELECT * EXCLUDE (category_id) FROM itf", "day_state_items")(lambda c: daystate.item_totals(_folded(c)))
_query("c", _CAT + " SELECT * FROM cf", "day_state_categories")(lambda c: daystate.category_totals(_folded(c)))
_query(
    "c",
    _user_sql(REFERENCE) + """ SELECT user_id, user_total_count, user_pv_count, user_fav_count, user_cart_count, user_buy_count, user_unique_item_count,
  user_unique_category_count, user_active_day_count, user_first_behavior_time, user_last_behavior_time FROM uf""",
    "day_state_users",
)(lambda c: daystate.user_totals(_folded(c)))


@_query("c", _CAT + " SELECT * FROM cf")
def snapshot_categories(c):
    """Two versions published by manifest, of half of the log and of all of it; the newest is read."""
    spark, root = c.sparkSession, stage.path_for(c.sparkSession, "versions")
    x = _cells(c)
    for part in (x.where("user_id % 2 = 0"), x):
        snapshot.publish_snapshot({"categories": features.category_features(part)}, root)
    return snapshot.read(spark, root, "categories")


_COLLAPSED = _ORACLES["burst_collapse"].removeprefix(_WITH["c"])


@_query("c", _COLLAPSED)
def streamed_burst_collapse(c):
    """The log as three files that a stream delivers one by one; counts and first rows are carried from batch to batch."""
    spark = c.sparkSession
    given, root, checkpoint = (stage.path_for(spark, name) for name in ("arrivals", "bursts", "stream"))
    parts = c.select("event_id", "time", "user_id", "item_id", "category_id", "behavior_type").repartitionByRange(3, F.xxhash64("event_id"))
    parts.write.parquet(given)
    log = bursts.BurstLog(spark, root, 3, "month")
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(given)
    log.run(stream, checkpoint)
    return log.collapsed()


_QS = (0.0, 0.2, 0.25, 0.5, 0.75, 0.8, 0.99, 1.0)


@_query("l", """, u AS (SELECT user_id, count(*) AS n FROM c GROUP BY user_id), i AS (SELECT user_id, item_id, count(*) AS n FROM c GROUP BY ALL) """ + " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS q, (SELECT quantile_cont(n, {q}::DOUBLE) FROM u) AS of_users, (SELECT round(quantile_cont(epoch(\"time\"), {q}::DOUBLE), 2) FROM c) AS of_times" for q in _QS))
def quantiles_by_rank(c):
    """Quantiles of totals by user, and of all times, by their ranks."""
    users = ranges.quantiles_by_rank(c.groupBy("user_id").agg(F.count("*").alias("n")), "n", _QS)
    seconds = F.unix_timestamp(F.col("time").cast("timestamp")).cast("double").alias("s")
    times = ranges.quantiles_by_rank(c.select(seconds), "s", _QS)
    return c.sparkSession.createDataFrame([(q, users[q], round(times[q], 2)) for q in _QS], "q double, of_users double, of_times double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
