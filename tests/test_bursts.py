"""Bursts over loads: the same as over the whole log, with batches delivered again and drivers that die."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import cleaning
from tidelog.sources import snapshot
from tidelog.sources.adapters import clean_events
from tidelog.streaming import bursts

COLUMNS = ["event_id", "time", "user_id", "item_id", "category_id", "behavior_type"]


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arrivals") / "log")
    c = clean_events(spark, sf_dir).select(*COLUMNS)
    again = c.limit(40).withColumn("event_id", F.col("event_id") + 1_000_000)
    c.union(again).union(again.withColumn("event_id", F.col("event_id") + 1_000_000)).repartition(3).write.parquet(path)
    return path


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_three_loads_equal_one(spark, log, tmp_path, monkeypatch):
    whole = spark.read.parquet(log)
    want = cleaning.collapse_bursts(whole, 3, "month")
    kept = bursts.BurstLog(spark, str(tmp_path / "state"), 3, "month")
    with pytest.raises(ValueError, match="no batch"):
        kept.rows()
    stream = lambda: spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(log)
    put, count = snapshot._put, 0

    def dies_once(*args):
        nonlocal count
        count += 1
        if count == 2:
            raise RuntimeError("the driver died")
        return put(*args)

    monkeypatch.setattr(snapshot, "_put", dies_once)
    with pytest.raises(Exception, match="died"):
        kept.run(stream(), str(tmp_path / "checkpoint"))
    monkeypatch.undo()
    kept.run(stream(), str(tmp_path / "checkpoint"))
    assert snapshot.manifest(spark, kept.root)["notes"] == {"batch": 2}
    assert rows_of(kept.collapsed()) == rows_of(want) and kept.rows().count() == whole.count() > want.count()
    groups = cleaning.burst_groups(whole, 3, "month")
    assert sorted(map(tuple, kept.bursts().select(*groups.columns).collect())) == sorted(map(tuple, groups.collect()))
    kept.fold(whole.limit(100), 1)  # delivered again
    assert rows_of(kept.collapsed()) == rows_of(want)
