"""Command line: ``python -m tidelog clean|describe|import|features|check|marts``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidelog.plans import jobs
from tidelog.sources import publish, stage
from tidelog.sources.schema import DEFAULT_BURST


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog")
    sub = parser.add_subparsers(dest="job", required=True)
    clean = sub.add_parser("clean", help="clean a raw CSV")
    clean.add_argument("--input", required=True)
    clean.add_argument("--output", required=True)
    clean.add_argument("--output-csv")
    clean.add_argument("--report")
    clean.add_argument("--markdown")
    clean.add_argument("--values-output")
    clean.add_argument("--by-date", action="store_true", help="a folder for each day")
    clean.add_argument("--allowed-start")
    clean.add_argument("--allowed-end")
    clean.add_argument("--suspicious-repeat-threshold", type=int, default=DEFAULT_BURST)
    features = sub.add_parser("features", help="build the feature tables")
    features.add_argument("--input", required=True)
    features.add_argument("--output-directory", required=True)
    features.add_argument("--reference", required=True)
    features.add_argument("--window-start")
    features.add_argument("--window-end")
    features.add_argument("--versions", action="store_true", help="publish as a new version by manifest")
    features.add_argument("--more", action="store_true", help="user activity, recent paths, item conversion and the wide table too")
    describe = sub.add_parser("describe", help="write the descriptive tables of a clean log")
    describe.add_argument("--input", required=True)
    describe.add_argument("--output-directory", required=True)
    describe.add_argument("--csv", action="store_true")
    table = sub.add_parser("import", help="import a raw CSV or a clean log as a table")
    table.add_argument("--input", required=True)
    table.add_argument("--table", required=True)
    table.add_argument("--clean", action="store_true")
    table.add_argument("--mode", default="skip", choices=sorted(publish.MODES))
    table.add_argument("--view")
    table.add_argument("--cluster-by", nargs="*")
    table.add_argument("--once", action="store_true", help="a file that is loaded again counts once")
    check = sub.add_parser("check", help="check published feature tables")
    check.add_argument("--features", required=True)
    check.add_argument("--report")
    check.add_argument("--markdown")
    marts = sub.add_parser("marts", help="build the dashboard tables")
    marts.add_argument("--features", required=True)
    marts.add_argument("--output-directory", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    publish.plan_by_statistics(spark)
    try:
        if a.job == "clean":
            done = jobs.clean_user_behavior(
                spark,
                a.input,
                a.output,
                output_csv=a.output_csv,
                report_path=a.report,
                markdown_path=a.markdown,
                values_output=a.values_output,
                by_date=a.by_date,
                allowed_start=a.allowed_start,
                allowed_end=a.allowed_end,
                suspicious_repeat_threshold=a.suspicious_repeat_threshold,
            ).report
        elif a.job == "features":
            done = jobs.build_features(spark, a.input, a.output_directory, a.reference, a.window_start, a.window_end, versions=a.versions, more=a.more)
        elif a.job == "describe":
            done = jobs.describe(spark, a.input, a.output_directory, a.csv)
        elif a.job == "import":
            done = {"rows": jobs.import_table(spark, a.input, a.table, clean=a.clean, mode=a.mode, view=a.view, cluster_by=a.cluster_by, once=a.once)}
        elif a.job == "check":
            done = jobs.check_features(spark, a.features, a.report, a.markdown)
            if not done["passed"]:
                print(json.dumps(done, default=str))
                return 1
        else:
            done = jobs.build_marts(spark, a.features, a.output_directory)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        stage.clear(spark)
    print(json.dumps(done, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
