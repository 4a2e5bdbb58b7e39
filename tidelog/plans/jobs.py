"""Whole jobs: clean a raw file, describe it, import it as a table, build and check feature tables, build the dashboard marts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import cleaning, features, marts, quality, sequences, stats
from tidelog.plans import sqltext
from tidelog.sources import files, publish, snapshot, stage
from tidelog.sources.schema import DEFAULT_BURST, RAW_COLUMNS, require_columns


@dataclass
class CleaningResult:
    path: str
    rows: int
    report: dict = field(repr=False)


def clean_user_behavior(
    spark: SparkSession,
    input_csv: str,
    output: str,
    *,
    output_csv: str | None = None,
    report_path: str | None = None,
    markdown_path: str | None = None,
    values_output: str | None = None,
    by_date: bool = False,
    allowed_start: str | None = None,
    allowed_end: str | None = None,
    suspicious_repeat_threshold: int = DEFAULT_BURST,
) -> CleaningResult:
    """Clean a raw CSV into Parquet (and CSV): reasons, bursts, validation of what was written, report.

    The raw file is read twice. The first pass writes the rows that are valid by themselves, and counters,
    reasons, codes and the range of time ride on that write as observed metrics; the second one groups equal raw rows, of
    which distinct ids, duplicates and all codes are counted. Bursts are found in what was written.

    Outputs only take their places once they have been read again and passed, the CSV too; a failure leaves
    older outputs as they were. With ``by_date`` the Parquet has a folder for each day, so that
    a window of time reads only its days (``files.read_clean``). ``values_output`` gets the rows of each raw
    behaviour code, of which there may be very many; the report has the known ones and one figure for the others.
    """
    publish.check_paths(spark, [input_csv], [p for p in (output, output_csv, report_path, markdown_path, values_output) if p])
    raw = files.read_raw_csv(spark, input_csv, with_position=True)
    watched, seen = cleaning.observed(cleaning.analyse(raw, allowed_start, allowed_end))
    kept = stage.stored(cleaning.clean(watched, keep=(files.POSITION,)), "valid")
    found = cleaning.figures(seen)
    counters, reasons = found["counters"], found["reasons"]
    if not counters["total_rows"]:
        raise ValueError(f"{input_csv} has a header and no rows")
    equal = stage.stored(cleaning.raw_groups(raw), "raw_groups")
    groups = stage.stored(cleaning.burst_groups(kept, suspicious_repeat_threshold, position=files.POSITION), "bursts")
    out = cleaning.without_bursts(kept, groups, position=files.POSITION).drop(files.POSITION)
    burst = cleaning.burst_summary(groups).first().asDict()
    if burst["removable_rows"]:
        reasons[cleaning.REASONS[-1]] = burst["removable_rows"]
    checks: dict[str, dict] = {}

    def validate(name: str, again: DataFrame) -> None:
        if name == "values":
            return
        checks[name] = quality.validate_clean(again, threshold=suspicious_repeat_threshold, start=_full(allowed_start), end=_full(allowed_end))
        quality.reconcile_removals(counters["total_rows"], checks[name]["rows"], reasons)

    form = publish.dated_form("behavior_date", ["time", "user_id"]) if by_date else publish.parquet_form()
    tables = {"clean": (out, output, form)}
    if output_csv:
        tables["csv"] = (out, output_csv, publish.csv_form())
    if values_output:
        tables["values"] = (cleaning.value_counts_of(equal), values_output)
    rows = publish.publish(tables, validate)["clean"]
    report = {
        "schema_version": 2,
        "total_rows": counters["total_rows"],
        "clean_rows": rows,
        "removal_reasons": reasons,
        "counters": counters,
        "distinct_ids": cleaning.distinct_ids_of(equal).first().asDict(),
        "duplicates": cleaning.duplicates_of(equal).first().asDict(),
        "bursts": burst,
        "behavior_values": found["values"],
        "time_range": {k: str(v) for k, v in found["time_range"].items()},
        "validation": checks["clean"],
    }
    if output_csv:
        report["validation_csv"] = checks["csv"]
    if report_path:
        publish.write_json(spark, report, report_path)
    if markdown_path:
        publish.write_text(spark, quality_report(report), markdown_path)
    stage.release(kept, equal, groups)
    return CleaningResult(output, rows, report)


def quality_report(report: dict) -> str:
    """The figures of a cleaning as Markdown."""
    summary = {"rows read": report["total_rows"], "rows kept": report["clean_rows"], "rows removed": report["total_rows"] - report["clean_rows"]}
    share = summary["rows removed"] / report["total_rows"] * 100
    sections = {
        "Summary": {**summary, "removed, per cent": f"{share:.6f}"},
        "Reasons for removal": report["removal_reasons"],
        "Faults, each row under all that it has": report["counters"],
        "Repeats": {**report["duplicates"], **report["bursts"]},
        "Distinct raw ids": report["distinct_ids"],
        "Raw behaviour codes": report["behavior_values"],
        "Range of time": report["time_range"],
        "Checks of the clean log, read again": report["validation"],
    }
    if "validation_csv" in report:
        sections["Checks of the CSV, read again"] = report["validation_csv"]
    return publish.render_markdown("Quality of the behaviour log", sections)


def _full(hour: str | None) -> str | None:
    return None if hour is None else f"{hour}:00:00"


#: What adds up to the rows of the log in each feature table.
TOTALS = {
    "user_features": "user_total_count",
    "item_features": "item_total_count",
    "category_features": "category_total_count",
    "time_features": "time_total_count",
    "user_item_features": "ui_pv_count + ui_fav_count + ui_cart_count + ui_buy_count",
}
FEATURE_INPUT = ["time", "user_id", "item_id", "category_id", "behavior_type", "behavior_date", "behavior_hour", "weekday"]


def feature_tables(clean: DataFrame, reference: str) -> dict[str, DataFrame]:
    """The five feature tables of a clean log or of its cells."""
    return {
        "user_features": features.user_features(clean, reference),
        "item_features": features.item_features(clean),
        "category_features": features.category_features(clean),
        "time_features": features.time_features(clean),
        "user_item_features": features.user_item_features(clean),
    }


def build_features(
    spark: SparkSession, input_path: str, output_directory: str, reference: str, window_start=None, window_end=None, *, versions: bool = False, more: bool = False
) -> dict[str, int]:
    """Build, validate and publish the feature, sequence and conversion tables, in order of their keys; all or none appear.

    The tables are made of the log's cells, which are written once; their totals must agree with the log's rows.
    With ``versions`` they appear as one new version of ``snapshot``, so not even a driver that dies leaves tables of
    two kinds; ``check_features`` and ``build_marts`` read either. ``more`` adds the tables of user activity by
    quantiles, recent paths, item conversion and the wide table of pairs.
    """
    clean = files.read_clean(spark, input_path, start=window_start, end=window_end)
    total = clean.count()
    if not total:
        raise ValueError("no row lies in the window")
    require_columns(clean, FEATURE_INPUT)
    cells = stage.stored(features.cells(clean), "cells")
    tables = feature_tables(cells, reference)
    tables["user_sequence_features"] = sequences.sequence_features(clean)
    tables["conversion_features"] = stats.conversion_features(clean)
    order = {**quality.KEYS, "user_sequence_features": ["user_id"]}
    if more:
        tables["user_activity"] = features.user_activity_p20_p80(cells)
        tables["user_recent_paths"] = sequences.recent_path_features(clean)
        tables["item_conversion"] = features.item_conversion_features(cells)
        tables["wide_user_item"] = features.wide_user_item(cells, reference, tables["user_sequence_features"])
        order |= {"user_activity": ["user_id"], "user_recent_paths": ["user_id"], "item_conversion": ["item_id"], "wide_user_item": ["user_id", "item_id"]}

    def validate(name: str, again: DataFrame) -> None:
        keys = order.get(name)
        if again.isEmpty():
            raise quality.ValidationError(f"{name} is empty")
        if keys:
            row = quality.pk_check(again, keys, name).first()
            if row["null_keys"] or row["duplicate_keys"]:
                raise quality.ValidationError(f"{name}: {row.asDict()}")
        if name in TOTALS:
            found = again.agg(F.sum(F.expr(TOTALS[name]))).first()[0]
            if found != total:
                raise quality.ValidationError(f"{name} counts {found} of {total} rows")
        if name in quality.feature_rules():
            failed = [r["rule"] for r in quality.rule_frame(again, quality.feature_rules()[name]).where("failures > 0").collect()]
            if failed:
                raise quality.ValidationError(f"{name} breaks {failed}")

    if versions:
        _, rows = snapshot.publish_snapshot(tables, output_directory, validate, {k: publish.parquet_form(v) for k, v in order.items()})
    else:
        rows = publish.publish({k: (df, f"{output_directory}/{k}") for k, df in tables.items()}, validate, sort_by=order)
    stage.release(cells)
    return rows


def check_features(spark: SparkSession, feature_directory: str, report_path: str | None = None, markdown_path: str | None = None) -> dict:
    """Rules on the published user, hour and sequence tables, and across them: failures by rule, and whether all pass."""
    names = {"user_features": "user_features", "time_features": "time_features", "sequence_features": "user_sequence_features"}
    paths = {name: snapshot.resolve(spark, feature_directory, path) for name, path in names.items()}
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    found = {r["rule"]: r["failures"] for r in quality.feature_qa_rules(tables).collect()}
    shapes = {name: files.parquet_profile(spark, path) for name, path in paths.items()}
    spread = {f"{r['feature']} {r['value']}": r["n"] for r in quality.distributions(tables).collect()}
    report = {"passed": not any(found.values()), "failures": found, "tables": shapes, "distributions": spread}
    if report_path:
        publish.write_json(spark, report, report_path)
    if markdown_path:
        rows = {name: x["rows"] for name, x in shapes.items()}
        status = f"STATUS = {'PASS' if report['passed'] else 'FAIL'}"
        publish.write_text(spark, publish.render_markdown("Checks of the feature tables", {"Rows": rows, "Rows that break a rule": found, "Distributions": spread}) + f"\n{status}\n", markdown_path)
    return report


def describe(spark: SparkSession, input_path: str, output_directory: str, csv: bool = False) -> dict[str, int]:
    """The descriptive tables of a clean log, as Parquet, or as CSV with one file each; rows by table."""
    clean = files.read_clean(spark, input_path)
    tables = {
        "behavior_distribution": stats.behavior_distribution(clean),
        "behavior_statistics": stats.behavior_statistics(clean),
        "item_statistics": stats.item_statistics(clean).orderBy("item_id"),
        "category_statistics": stats.category_statistics(clean).orderBy("category_id"),
        "top_items": stats.top(stats.item_statistics(clean), "buy_count", "item_id", 10),
        "top_categories": stats.top(stats.category_statistics(clean), "buy_count", "category_id", 10),
        "daily_behavior": stats.daily_behavior(clean).orderBy("behavior_date"),
        "hourly_behavior": stats.hourly_behavior(clean).orderBy("behavior_hour"),
        "hourly_pivot": stats.hourly_pivot(clean).orderBy("behavior_hour"),
        "descriptive_funnel": stats.descriptive_funnel(clean),
        "time_summary": stats.time_summary(clean),
        "peak_hours": stats.peak_hours(clean),
    }
    form = lambda name: [publish.csv_form(single_file=name != "item_statistics")] if csv else []
    return publish.publish({k: (df, f"{output_directory}/{k}", *form(k)) for k, df in tables.items()})


#: The column of a table that keeps its loads apart.
LOADED = "loaded_from"


def import_table(
    spark: SparkSession, input_path: str, table: str, *, clean: bool = False, mode: str = "skip", view: str | None = None, cluster_by: list[str] | None = None, once: bool = False
) -> int:
    """A raw CSV (or, with ``clean``, a clean Parquet log) as a catalogue table, verified; its rows are returned.

    An existing table is kept with mode ``skip``, else it is an error (``fail``), replaced or added
    to. ``view`` names a view with derived columns over a raw table. Clustering, by default by
    user and time, and column statistics stand for indexes. With ``once`` the table keeps the rows of each
    loaded file apart, so a load that is run again, after a crash too, takes the place of its own rows
    instead of adding them twice; its last column names the file.
    """
    if mode not in publish.MODES:
        raise ValueError(f"mode must be one of {sorted(publish.MODES)}")
    source = LOADED if once else None
    df = files.read_clean(spark, input_path, source=source) if clean else files.read_typed_csv(spark, input_path, source)
    if once:
        rows = publish.load_once(df, table, mode, LOADED, cluster_by or ["user_id", "time"])
        publish.verify(spark, table, rows, df.columns)
        return rows
    exists = spark.catalog.tableExists(table)
    before = spark.table(table).count() if exists and mode in ("skip", "append") else 0
    publish.write_table(df, table, mode=mode, cluster_by=cluster_by or ["user_id", "time"], statistics=True)
    rows = before if exists and mode == "skip" else before + df.count()
    publish.verify(spark, table, rows, df.columns, [kind for _, kind in df.dtypes])
    if view and not clean:
        mapped = sqltext.mapped_view(spark.table(table).select(*(F.col(c).cast("string") for c in RAW_COLUMNS)))
        publish.create_view(mapped, view)
        publish.verify(spark, view, rows, mapped.columns)
    return rows


def build_marts(spark: SparkSession, feature_directory: str, output_directory: str) -> dict[str, int]:
    """The dashboard's tables, from published feature tables."""
    read = lambda name: spark.read.parquet(snapshot.resolve(spark, feature_directory, name))
    tables = {
        "item_conversion": marts.item_mart(read("item_features")),
        "category_conversion": marts.category_mart(read("category_features")),
        "user_behavior_depth": marts.user_depth_mart(read("user_features")),
        "conversion_funnel": read("conversion_features"),
    }
    return publish.publish({k: (df, f"{output_directory}/{k}") for k, df in tables.items()})
