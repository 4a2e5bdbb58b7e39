"""Jobs over published files and tables: description, import, checks, and publishing that fails half way."""

import pytest
from pyspark.sql import functions as F

from tidelog.__main__ import main
from tidelog.plans import jobs
from tidelog.sources import files, publish
from tidelog.sources.adapters import REFERENCE, clean_events, raw_events
from tidelog.sources.schema import CLEAN_COLUMNS, RAW_COLUMNS


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "clean")
    clean_events(spark, sf_dir).select(*CLEAN_COLUMNS).write.parquet(path)
    return path


def test_features_are_ordered_and_checked(spark, log, tmp_path):
    out = str(tmp_path / "features")
    rows = jobs.build_features(spark, log, out, REFERENCE)
    users = spark.read.parquet(f"{out}/user_features")
    ids = [r[0] for r in users.select("user_id").collect()]
    assert rows["user_features"] == len(ids) and ids == sorted(ids)
    report = jobs.check_features(spark, out, str(tmp_path / "qa.json"), str(tmp_path / "qa.md"))
    assert report["passed"] and report["failures"]["same_user_set"] == 0
    assert report["tables"]["user_features"]["rows"] == rows["user_features"]
    assert files.status_passed(spark, str(tmp_path / "qa.md"))
    broken = users.where("user_id % 2 = 0").withColumn("user_activity_level", F.lit("odd")).collect()
    publish.publish({"u": (spark.createDataFrame(broken, users.schema), f"{out}/user_features")})
    found = jobs.check_features(spark, out, markdown_path=str(tmp_path / "qa.md"))
    assert not found["passed"] and found["failures"]["same_user_set"] > 0 and found["failures"]["user_level_known"] == len(broken)
    assert not files.status_passed(spark, str(tmp_path / "qa.md"))


def test_description(spark, log, tmp_path):
    n = spark.read.parquet(log).count()
    rows = jobs.describe(spark, log, str(tmp_path / "eda"))
    assert rows == jobs.describe(spark, log, str(tmp_path / "csv"), csv=True)
    assert rows["top_items"] == 10 and rows["hourly_behavior"] == rows["hourly_pivot"] == 24
    counts = [r.behavior_count for r in spark.read.parquet(str(tmp_path / "eda" / "behavior_distribution")).collect()]
    assert sum(counts) == n and counts == sorted(counts, reverse=True)
    places = [(r.time_dimension, r.time_value) for r in spark.read.parquet(str(tmp_path / "eda" / "time_summary")).collect()]
    days = [("weekday", d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]
    assert places == [*(("hour", str(h)) for h in range(24)), *days, ("day_type", "weekday"), ("day_type", "weekend")]


def test_import_modes_view_and_types(spark, sf_dir, log, tmp_path):
    raw = raw_events(spark, sf_dir).where("item_id <> ''").select(*RAW_COLUMNS)
    publish.write_csv(raw, str(tmp_path / "raw"), single_file=True)
    n, path = raw.count(), str(tmp_path / "raw")
    with pytest.raises(ValueError, match="mode"):
        jobs.import_table(spark, path, "imported_log", mode="other")
    try:
        assert jobs.import_table(spark, path, "imported_log", view="mapped_log") == n
        assert jobs.import_table(spark, path, "imported_log") == n  # kept
        assert spark.table("mapped_log").where("behavior_name = 'pv'").count() == raw.where("behavior_type = '1'").count()
        assert dict(spark.table("imported_log").dtypes)["user_id"] == "bigint"
        with pytest.raises(Exception, match="already exists"):
            jobs.import_table(spark, path, "imported_log", mode="fail")
        assert jobs.import_table(spark, path, "imported_log", mode="append") == 2 * n
        assert jobs.import_table(spark, log, "imported_clean", clean=True, mode="replace") == spark.read.parquet(log).count()
        with pytest.raises(ValueError, match="rows"):
            publish.verify(spark, "imported_clean", 1, CLEAN_COLUMNS)
        with pytest.raises(ValueError, match="types"):
            publish.verify(spark, "imported_log", 2 * n, RAW_COLUMNS, ["string"] * 5)
        with pytest.raises(ValueError, match="does not exist"):
            publish.verify(spark, "no_such_table", 1, [])
    finally:
        spark.sql("DROP TABLE IF EXISTS imported_log")
        spark.sql("DROP TABLE IF EXISTS imported_clean")
    (tmp_path / "bad.csv").write_text(",".join(RAW_COLUMNS) + "\n2024-01-01 00,x,1,1,1\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ"):
        files.read_typed_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_swap_of_several_tables_is_all_or_none(spark, tmp_path):
    targets = {name: str(tmp_path / name) for name in ("a", "b")}
    publish.publish({k: (spark.range(2), t) for k, t in targets.items()})
    staged = [(f"{t}-new", t) for t in targets.values()]
    for stage, _ in staged:
        publish.write_parquet(spark.range(9), stage)
    with pytest.raises(Exception):
        publish._swap(spark, [*staged, (str(tmp_path / "missing"), str(tmp_path / "c"))])
    assert [spark.read.parquet(t).count() for t in targets.values()] == [2, 2]
    assert not [p.name for p in tmp_path.iterdir() if p.name.endswith("-old")]


class Builder:
    """Stands for SparkSession: hands out the session of the tests."""

    session = None

    @property
    def builder(self):
        return self

    def config(self, *_):
        return self

    def getOrCreate(self):  # noqa: N802
        return self.session


def test_command_line(spark, log, tmp_path, monkeypatch, capsys):
    Builder.session = spark
    monkeypatch.setattr("tidelog.__main__.SparkSession", Builder())
    assert main(["describe", "--input", log, "--output-directory", str(tmp_path / "eda")]) == 0
    assert "behavior_distribution" in capsys.readouterr().out
    assert main(["clean", "--input", str(tmp_path / "none.csv"), "--output", str(tmp_path / "c")]) == 1
