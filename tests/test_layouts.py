"""One-pass cleaning, the log by days, versions by manifest, loads that may be run again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidelog.operators import daystate, features, ranges, sequences
from tidelog.plans import jobs
from tidelog.sources import files, publish, snapshot, stage
from tidelog.sources.adapters import REFERENCE, clean_events
from tidelog.sources.schema import CLEAN, CLEAN_COLUMNS, RAW_COLUMNS

HEAD = ",".join(RAW_COLUMNS) + "\n"
SAMPLE = HEAD + "2024-05-01 03,8,9,1,1\n2024-05-01 03,8,9,1,1\n 2024-05-02 04 ,8,9,2,4\n2024-05-03 05,7,9,2,3\nbad,1,1,1,1\n,1,1,1,9\n2024-05-03 06,x,1,1,2\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_raw_file_is_read_twice(spark, tmp_path, monkeypatch):
    rows = 4000
    lines = "".join(f"2024-05-{1 + i % 28:02d} {i % 24:02d},{1 + i % 90},{1 + i % 70},{1 + i % 5},{1 + i % 4}\n" for i in range(rows - 70))
    path = write(tmp_path / "raw.csv", HEAD + lines + "2024-06-01 00,1,1,1,1\n" * 70)
    read = []
    own = files.read_raw_csv
    accumulator = spark.sparkContext.accumulator(0)

    def counted(*args, **kwargs):
        df = own(*args, **kwargs)
        see = F.udf(lambda x: accumulator.add(1) or x, "string").asNondeterministic()
        read.append(1)
        return df.withColumn("time", see("time"))

    monkeypatch.setattr(files, "read_raw_csv", counted)
    got = jobs.clean_user_behavior(spark, path, str(tmp_path / "clean"), output_csv=str(tmp_path / "csv"), values_output=str(tmp_path / "values"))
    assert len(read) == 1 and accumulator.value == 2 * rows
    assert got.rows == rows - 69 and got.report["total_rows"] == rows and got.report["removal_reasons"] == {"suspicious_repeat": 69}
    assert got.report["distinct_ids"] == {"distinct_user_id": 90, "distinct_item_id": 70, "distinct_item_category": 5}
    assert files.read_clean_csv(spark, str(tmp_path / "csv")).count() == got.rows
    assert {r.value: r.n for r in spark.read.parquet(str(tmp_path / "values")).collect()} == got.report["behavior_values"]


def test_figures_ride_on_the_write(spark, tmp_path):
    got = jobs.clean_user_behavior(spark, write(tmp_path / "a.csv", SAMPLE), str(tmp_path / "clean"), report_path=str(tmp_path / "report.json"))
    report = json.loads((tmp_path / "report.json").read_text())
    assert got.rows == report["clean_rows"] == 4
    assert report["removal_reasons"] == {"missing_critical_field": 1, "unparseable_time": 1, "invalid_id": 1}
    assert report["behavior_values"] == {"1": 3, "2": 1, "3": 1, "4": 1, "<other>": 1}
    assert report["time_range"] == {"min_time": "2024-05-01 03:00:00", "max_time": "2024-05-03 06:00:00"}
    assert report["duplicates"] == {"total_rows": 7, "full_duplicates": 1, "four_key_duplicates": 1}
    assert report["distinct_ids"] == {"distinct_user_id": 4, "distinct_item_id": 2, "distinct_item_category": 2}
    assert report["counters"]["invalid_user_id"] == 1 and report["counters"]["total_rows"] == 7


def test_a_failure_leaves_both_old_outputs(spark, tmp_path, monkeypatch):
    paths = {"output": str(tmp_path / "clean"), "output_csv": str(tmp_path / "csv")}
    source = write(tmp_path / "a.csv", SAMPLE)
    jobs.clean_user_behavior(spark, source, **paths)
    more = write(tmp_path / "b.csv", SAMPLE + "2024-05-09 05,7,9,2,3\n")
    own = publish.csv_form

    def broken(single_file=False):
        form = own(single_file)
        return publish.Form(lambda df, path: form.write(df.withColumn("user_id", F.lit("x")), path), form.read)

    monkeypatch.setattr(publish, "csv_form", broken)
    with pytest.raises(Exception):
        jobs.clean_user_behavior(spark, more, **paths)
    monkeypatch.undo()
    assert spark.read.parquet(paths["output"]).count() == files.read_clean_csv(spark, paths["output_csv"]).count() == 4
    assert sorted(x for x in os.listdir(tmp_path) if "staging" in x) == []
    assert jobs.clean_user_behavior(spark, more, **paths).rows == 5
    assert spark.read.parquet(paths["output"]).count() == files.read_clean_csv(spark, paths["output_csv"]).count() == 5


@pytest.fixture(scope="module")
def dated(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dated") / "log")
    log = clean_events(spark, sf_dir).select(*CLEAN_COLUMNS)
    publish.publish({"log": (log, path, publish.dated_form("behavior_date", ["time", "user_id"]))})
    return path


def _scan(df):
    """(files read, number of partitions read) of a query that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        metrics = node.metrics()
        if "FileSourceScan" in node.getClass().getName() and metrics.contains("numPartitions"):
            return metrics.apply("numFiles").value(), metrics.apply("numPartitions").value(), node.toString()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if "AdaptiveSparkPlan" in node.getClass().getName():
            nodes.append(node.executedPlan())
        if "QueryStage" in node.getClass().getName():
            nodes.append(node.plan())
    raise AssertionError("no scan")


def test_a_window_reads_its_days(spark, sf_dir, dated):
    log = clean_events(spark, sf_dir).select(*CLEAN_COLUMNS)
    whole = files.read_clean(spark, dated)
    assert [(f.name, f.dataType) for f in whole.schema] == [(f.name, f.dataType) for f in CLEAN] and whole.exceptAll(log).count() == log.exceptAll(whole).count() == 0
    days = sorted(r[0] for r in log.select("behavior_date").distinct().collect())
    day = days[len(days) // 2]
    one = files.read_clean(spark, dated, ["user_id", "time"], f"{day} 00:00:00", f"{day} 23:00:00")
    n_files, n_partitions, plan = _scan(one)
    assert n_partitions == 1 and n_files >= 1 and "PartitionFilters: [" in plan and "behavior_date" in plan.split("PartitionFilters")[1]
    assert one.count() == log.where(F.col("behavior_date") == day).count() > 0
    assert _scan(files.read_clean(spark, dated, ["user_id"]))[1] == len(days)


def test_days_of_a_joined_table_prune_the_log(spark, dated, tmp_path):
    log = files.read_clean(spark, dated)
    days = log.select("behavior_date").distinct().orderBy("behavior_date").limit(2).collect()
    calendar = spark.createDataFrame([(d[0], "holiday") for d in days] + [("1999-01-01", "none")], "behavior_date string, kind string")
    calendar.write.parquet(str(tmp_path / "calendar"))
    joined = log.join(spark.read.parquet(str(tmp_path / "calendar")).where("kind = 'holiday'"), "behavior_date")
    assert _scan(joined.select("user_id"))[1] == 2


def test_features_of_a_dated_log(spark, dated, tmp_path):
    rows = jobs.build_features(spark, dated, str(tmp_path / "f"), REFERENCE, more=True)
    assert rows["wide_user_item"] == rows["user_item_features"] and rows["user_activity"] == rows["user_features"] == rows["user_recent_paths"] and rows["item_conversion"] == rows["item_features"]


class Dies(RuntimeError):
    pass


def test_readers_find_all_old_or_all_new_tables(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "versions")
    tables = lambda n: {x: spark.range(n).withColumn("of", F.lit(x)) for x in ("a", "b", "c")}
    seen = lambda: {x: snapshot.read(spark, root, x).count() for x in ("a", "b", "c")}
    assert snapshot.manifest(spark, root) is None and snapshot.resolve(spark, root, "a") == f"{root}/a"
    assert snapshot.publish_snapshot(tables(2), root)[0] == 1
    steps = 0

    def dying(at):
        """Every call that changes something on disk counts as a step; the step ``at`` dies before, ``at`` + 0.5 after it is done."""
        count = 0

        def wrap(f):
            def call(*args, **kwargs):
                nonlocal count
                count += 1
                if count == at:
                    raise Dies
                out = f(*args, **kwargs)
                if count == at - 0.5:
                    raise Dies
                return out

            return call

        form = publish.parquet_form()
        monkeypatch.setattr(publish, "parquet_form", lambda sort_by=None: publish.Form(wrap(form.write), form.read))
        monkeypatch.setattr(snapshot, "_put", wrap(put))
        return lambda: count

    put = snapshot._put
    outcomes = []
    for at in (1, 1.5, 2, 2.5, 3, 3.5, 4):
        dying(at)
        with pytest.raises(Dies):
            snapshot.publish_snapshot(tables(3), root)
        monkeypatch.undo()
        outcomes.append(seen())
        steps += 1
    assert outcomes == [{"a": 2, "b": 2, "c": 2}] * steps
    # a manifest that was cut short is passed over, and its number is not used again
    manifests = tmp_path / "versions" / "manifests"
    (manifests / "000000000002.json").write_text('{"body": {"version": 2, "tab')
    assert seen() == {"a": 2, "b": 2, "c": 2}
    assert snapshot.publish_snapshot(tables(3), root)[0] == 3 and seen() == {"a": 3, "b": 3, "c": 3}
    assert snapshot.publish_snapshot({"b": spark.range(9).withColumn("of", F.lit("b"))}, root)[0] == 4
    assert seen() == {"a": 3, "b": 9, "c": 3} and snapshot.read(spark, root, "b", 3).count() == 3
    with pytest.raises(snapshot.ConflictError):
        snapshot._put(spark, f"{root}/manifests/000000000004.json", "x")
    with pytest.raises(ValueError, match="no table"):
        snapshot.read(spark, root, "z")
    gone = snapshot.vacuum(spark, root, keep=1)
    assert gone and seen() == {"a": 3, "b": 9, "c": 3} and len(os.listdir(tmp_path / "versions" / "data")) == 3


def test_jobs_over_versions(spark, dated, tmp_path):
    root = str(tmp_path / "v")
    rows = jobs.build_features(spark, dated, root, REFERENCE, versions=True)
    report = jobs.check_features(spark, root)
    assert report["passed"] and report["tables"]["user_features"]["rows"] == rows["user_features"]
    assert sum(n for k, n in report["distributions"].items() if k.startswith("time_period ")) == rows["time_features"]
    assert report["distributions"]["user_activity_level high"] > 0 and report["distributions"]["is_weekend 1"] > 0
    assert jobs.build_marts(spark, root, str(tmp_path / "marts"))["item_conversion"] == rows["item_features"]


def test_a_load_that_is_run_again_counts_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = "2024-05-01 03,8,{},1,1\n"
    write(folder / "a.csv", HEAD + row.format(1) * 3)
    load = lambda mode="append": jobs.import_table(spark, str(folder), "once_log", mode=mode, once=True)
    try:
        assert load() == 3 and load() == 3 and load("skip") == 3
        write(folder / "b.csv", HEAD + row.format(2) * 5)
        assert load() == 8 and load() == 8
        assert spark.table("once_log").columns == [*RAW_COLUMNS, jobs.LOADED]
        assert spark.table("once_log").select(jobs.LOADED).distinct().count() == 2
        assert load("replace") == 8
        with pytest.raises(ValueError, match="already exists"):
            load("fail")
    finally:
        spark.sql("DROP TABLE IF EXISTS once_log")


def _exchanges(df):
    """Keys of the shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_tables_in_buckets_are_joined_without_a_shuffle(spark, dated):
    log = files.read_clean(spark, dated)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = stage.bucketed(features.cells(log), "cells", ["user_id"])
        found = stage.bucketed(sequences.sequence_features(log), "sequences", ["user_id"])
        pairs = features.user_item_features(cells)
        users = features.user_features(cells, REFERENCE).join(found, "user_id", "left")
        assert _exchanges(pairs.join(users, "user_id", "left")) == []
        wide = features.wide_user_item(cells, REFERENCE, found)
        assert "user_id" not in _exchanges(wide)
        plain = features.wide_user_item(log, REFERENCE, sequences.sequence_features(log))
        assert "user_id" in _exchanges(plain)
        assert wide.exceptAll(plain).count() == plain.exceptAll(wide).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    hot = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("user_id"))
    flat = stage.bucketed(hot, "hot", ["user_id"], buckets=16)
    assert _exchanges(flat.groupBy("user_id").count()) and flat.count() == 4000
    path = cells.stored_at
    stage.release(cells, found)
    assert not os.path.exists(path.removeprefix("file:"))


def test_a_state_of_days_equals_all_rows(spark, dated, monkeypatch):
    monkeypatch.setattr(daystate, "SHORT", 3)  # both kinds of block
    log = files.read_clean(spark, dated)
    many = spark.range(20_000).select(
        F.lit("2024-03-01 05:00:00").cast("timestamp_ntz").alias("time"), (F.col("id") * 7 - 50_000).alias("user_id"), F.lit(3).cast("long").alias("item_id"), F.lit(4).cast("long").alias("category_id"),
        F.lit(4).alias("behavior_type"), F.lit("buy").alias("behavior_name"), F.lit("2024-03-01").alias("behavior_date"), F.lit(5).alias("behavior_hour"), F.lit(4).alias("weekday"),
    )
    parts = [features.cells(x) for x in (log.where("behavior_date < '2024-01-10'"), log.where("behavior_date >= '2024-01-10'"), many)]
    keep = lambda state: tuple(stage.stored(x, "state") for x in state)
    states = [keep(daystate.of_rows(x)) for x in parts]
    folded = keep(daystate.fold(keep(daystate.fold(states[0], states[1])), states[2]))
    other = keep(daystate.fold(states[2], keep(daystate.fold(states[1], states[0]))))
    whole = features.cells(log.unionByName(many))
    same = lambda a, b: sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(a.columns)).collect()))
    for state in (folded, other):
        assert same(daystate.item_totals(state), features.item_features(whole))
        assert same(daystate.category_totals(state), features.category_features(whole))
        assert same(daystate.user_totals(state), features.user_features(whole, REFERENCE))
    assert folded[1].where("bits IS NOT NULL").count() > 0 and folded[1].where("bits IS NULL").count() > 0
    # a day that is folded into the sets twice changes no number
    again = daystate.fold(folded, (states[1][0].where("false"), states[1][1]))
    assert same(daystate.counts(again[1]), daystate.counts(folded[1]))
    # folding reads the day and the state, and no log
    plan = daystate.fold(folded, states[2])[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "behavior_hour" not in plan


def _ahead(rows, n):
    """Next ``n`` names of each row's pair, by hand."""
    out = {}
    for i, (u, k, t, b, name) in enumerate(rows):
        later = [r[4] for r in rows[i + 1 : i + 1 + n] if r[:2] == (u, k)]
        out.setdefault((u, k, t, b, name), []).append(tuple(later + [None] * (n - len(later))))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_leads_of_a_pair_with_half_of_the_log(spark, tmp_path):
    names = {1: "pv", 2: "fav", 3: "cart", 4: "buy"}
    rows = [(u % 7, u % 5, i, 1 + (i * 7 + u) % 4) for u in range(60) for i in range(8)] + [(1, 1, 100 + i, 1 + (i * i) % 4) for i in range(500)]
    rows = sorted({(u, k, t, b) for u, k, t, b in rows})
    rows = [(*r, names[r[3]]) for r in rows]
    frame = spark.createDataFrame(rows, "user_id long, item_id long, time long, behavior_type int, behavior_name string").repartition(5)
    for stretch in (3, 10, 100_000):
        got = ranges.leads(frame, ["user_id", "item_id"], ["time", "behavior_type"], "behavior_name", 3, stretch)
        assert got.columns == [*frame.columns, "n1", "n2", "n3"]
        found = {}
        for r in got.collect():
            found.setdefault(tuple(r)[:5], []).append(tuple(r)[5:])
        assert {k: sorted(v, key=str) for k, v in found.items()} == _ahead(rows, 3), stretch
    assert ranges.leads(frame.where("false"), ["user_id", "item_id"], ["time"], "behavior_name", 3).count() == 0


def test_quantiles_by_rank_equal_the_sorted_values(spark):
    values = [(i * i) % 977 - 300 for i in range(4001)] + [5] * 3000
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "x long")
    got = ranges.quantiles_by_rank(frame, "x", (0.0, 0.1, 0.2, 0.5, 0.77, 1.0))
    values.sort()
    for q, x in got.items():
        at = q * (len(values) - 1)
        low = int(at)
        high = min(low + 1, len(values) - 1)
        assert abs(x - (values[low] + (values[high] - values[low]) * (at - low))) < 1e-9
    assert ranges.quantiles_by_rank(frame.where("x IS NULL"), "x", (0.5,)) == {0.5: None}


def test_statistics_change_estimates_and_the_order_of_joins(spark):
    tables = {"st_log": 6000, "st_items": 3000, "st_rare": 4}
    try:
        publish.plan_by_statistics(spark)
        publish.write_table(spark.range(6000).select((F.col("id") % 3000).alias("item"), (F.col("id") % 1000).alias("kind"), F.when(F.col("id") < 5900, 1).otherwise(F.col("id")).alias("x")), "st_log", statistics=True)
        publish.write_table(spark.range(3000).select(F.col("id").alias("item"), F.lit("a").alias("a")), "st_items", statistics=True)
        publish.write_table(spark.range(4).select(F.col("id").alias("kind"), F.lit("b").alias("b")), "st_rare", statistics=True)

        def look(on):
            publish.plan_by_statistics(spark, on)
            query = spark.table("st_log").join(spark.table("st_items"), "item").join(spark.table("st_rare"), "kind")
            plan = query._jdf.queryExecution().optimizedPlan()
            estimate = spark.table("st_log").where("x > 3000")._jdf.queryExecution().optimizedPlan().stats().rowCount()
            names = [x for x in plan.toString().replace("`", "").split() if "st_" in x]
            return [n for line in names for n in tables if n in line], int(str(estimate.get())) if estimate.isDefined() else None, query.count()

        with_, without = look(True), look(False)
        assert with_[2] == without[2] == 24
        assert with_[1] is not None and with_[1] < 1000 and without[1] is None  # the histogram knows that few are so large
        assert with_[0] != without[0] and with_[0].index("st_rare") < with_[0].index("st_items")
    finally:
        publish.plan_by_statistics(spark, False)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
