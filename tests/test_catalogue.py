import duckdb
import pytest

from tidelog.plans import catalogue
from tidelog.sources.adapters import clean_events

TABLES = ("events", "lineitem", "orders", "part")
CHECKED = (
    "raw_missing_profile",
    "removal_reasons",
    "quality_counters",
    "duplicate_diagnostics",
    "burst_collapse",
    "behavior_distribution_sql",
    "behavior_statistics_sql",
    "descriptive_funnel_sql",
    "time_summary",
    "peak_hours",
    "recent_path_features",
    "segment_summary",
    "wide_user_item",
    "raw_overview",
    "distinct_raw_ids",
    "schema_feature_flags",
    "user_set_equality",
    "kpis",
    "dated_log_window",
    "day_state_items",
    "day_state_users",
    "snapshot_categories",
    "streamed_burst_collapse",
    "quantiles_by_rank",
    "feature_distributions",
)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_duckdb(spark, sf_dir, db, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    names = ", ".join(f'"{c}"' for c in columns)
    assert sorted(db.sql(catalogue.oracle_sql()[name]).columns) == columns
    assert text(df.select(*columns).collect()) == text(db.sql(f"SELECT {names} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_all_rules_pass(spark, sf_dir):
    assert {r.status for r in catalogue.queries()["feature_qa_rules"](spark, sf_dir).collect()} == {"PASS"}


def test_plans_have_no_python_and_prune_columns(spark, sf_dir):
    df = catalogue.queries()["daily_behavior"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "value" not in plan.split("ReadSchema")[1]
    window = clean_events(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in window
