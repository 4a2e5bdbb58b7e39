import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import features, quality, sequences, stats
from tidelog.plans import jobs
from tidelog.sources import publish
from tidelog.sources.schema import BEHAVIORS, CLEAN

REFERENCE = "2024-04-06 00:00:00"


def clean(spark, rows):
    out = []
    for time, user, item, category, code in rows:
        t = dt.datetime.fromisoformat(time)
        out.append((t, user, item, category, code, BEHAVIORS[code], time[:10], t.hour, t.weekday()))
    return spark.createDataFrame(out, CLEAN)


@pytest.fixture(scope="module")
def eight(spark):
    return clean(
        spark,
        [
            ("2024-04-02 08:00", 51, 900, 61, 1),
            ("2024-04-02 10:00", 51, 900, 61, 3),
            ("2024-04-02 13:00", 51, 900, 61, 4),
            ("2024-04-04 08:00", 51, 901, 62, 1),
            ("2024-04-04 20:00", 51, 901, 62, 4),
            ("2024-04-05 09:00", 52, 900, 61, 1),
            ("2024-04-05 09:00", 52, 900, 61, 1),
            ("2024-04-05 09:00", 52, 900, 61, 3),
        ],
    )


def test_tables_reconcile(spark, eight, tmp_path):
    eight.write.parquet(str(tmp_path / "clean"))
    rows = jobs.build_features(spark, str(tmp_path / "clean"), str(tmp_path / "out"), REFERENCE, "2024-04-01 00:00:00", "2024-04-30 23:00:00")
    assert rows == {
        "user_features": 2,
        "item_features": 2,
        "category_features": 2,
        "time_features": 6,
        "user_item_features": 3,
        "user_sequence_features": 2,
        "conversion_features": 1,
    }
    assert jobs.build_marts(spark, str(tmp_path / "out"), str(tmp_path / "marts"))["conversion_funnel"] == 1


@pytest.mark.parametrize("written_as", ["rows", "cells"])
def test_user_and_item(eight, written_as):
    log = features.cells(eight) if written_as == "cells" else eight
    u = {r.user_id: r for r in features.user_features(log, REFERENCE).collect()}
    assert (u[51].user_total_count, u[51].user_buy_count, u[51].user_buy_to_pv_rate) == (5, 2, 1.0)
    assert (u[51].user_behavior_span_hours, u[51].user_recency_hours, u[51].user_avg_daily_behavior_count) == (60.0, 28.0, 2.5)
    assert (u[51].user_unique_item_count, u[51].user_unique_category_count, u[52].user_unique_item_count) == (2, 2, 1)
    assert (u[51].user_activity_level, u[52].user_activity_level) == ("high", "low")
    i = {r.item_id: r for r in features.item_features(log).collect()}[900]
    assert (i.item_total_count, i.item_unique_user_count, i.item_unique_buyer_count, i.item_active_day_count, i.category_id) == (6, 2, 1, 2, 61)
    p = features.user_item_features(log).where("user_id = 51 and item_id = 900").first()
    assert (p.ui_pv_count, p.ui_cart_count, p.ui_buy_count, p.ui_last_interaction_hour, p.ui_has_bought) == (1, 1, 1, 13, 1)
    t = {(str(r.behavior_date), r.behavior_hour): r for r in features.time_features(log).collect()}["2024-04-05", 9]
    assert (t.time_total_count, t.time_unique_user_count, t.time_unique_item_count, t.weekday, t.time_period) == (3, 1, 1, 4, "morning")


def test_sequences(eight):
    s = {r.user_id: r for r in sequences.sequence_features(eight).collect()}
    assert s[51].sequence_recent_10_behavior_types == [1, 3, 4, 1, 4] and s[51].sequence_avg_behavior_gap_hours == 15.0
    assert (s[51].sequence_has_pv_cart, s[51].sequence_has_pv_fav, s[51].sequence_has_pv_buy, s[51].sequence_has_pv_cart_buy) == (1, 0, 1, 1)
    assert s[52].sequence_recent_10_behavior_types == [1, 1, 3] and (s[52].sequence_has_pv_cart, s[52].sequence_has_pv_buy) == (1, 0)


def test_conversion(eight):
    c = stats.conversion_features(eight).first()
    assert (c.pv_to_cart_rate, c.pv_to_buy_rate, c.fav_to_buy_rate, c.cart_to_buy_rate) == (0.5, 0.5, 0.0, 1.0)


def test_canonical_category_breaks_ties_by_id(spark):
    rows = [("2024-04-02 07:00", 1, 1, c, 1) for c in (5, 5, 3, 3, 1)]
    assert features.canonical_item_category(clean(spark, rows)).first().category_id == 3


def test_chain_forms_agree_and_partitions_do_not_matter(spark):
    rng = random.Random(3)
    rows = [
        (f"2024-04-{rng.randint(11, 13)} {rng.randint(0, 5):02}:00", rng.randint(1, 25), rng.randint(1, 6), rng.randint(1, 3), rng.randint(1, 4))
        for _ in range(600)
    ]
    c = clean(spark, rows)
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(sequences.chain_flags_windowed(c))
    assert sum(r[4] for r in want) > 0
    recent = key(sequences.recent_10(c))
    for n in (1, 3, 17):
        shuffled = c.orderBy(F.xxhash64("user_id", "time", "item_id", F.lit(n))).repartition(n)
        assert key(sequences.chain_flags(shuffled)) == want
        assert key(sequences.recent_10(shuffled)) == recent


def test_empty_log(spark):
    c = spark.createDataFrame([], CLEAN)
    assert features.user_features(c, REFERENCE).count() == 0
    assert sequences.sequence_features(c).count() == 0
    assert stats.behavior_statistics(c).first().total_users == 0
    assert [r.pct_of_pv for r in stats.descriptive_funnel(c).collect()] == [None] * 4


def test_validate_clean(spark, eight):
    assert quality.validate_clean(eight)["preserved_repeats"] == 1
    with pytest.raises(quality.ValidationError):
        quality.validate_clean(eight, threshold=2)
    with pytest.raises(quality.ValidationError):
        quality.validate_clean(eight.withColumn("behavior_hour", F.lit(99)))


def test_failed_publish_keeps_the_old(spark, tmp_path):
    target = str(tmp_path / "t")
    publish.publish({"t": (spark.range(2), target)})

    def refuse(name, again):
        raise ValueError("no")

    with pytest.raises(ValueError):
        publish.publish({"t": (spark.range(9), target)}, refuse)
    assert spark.read.parquet(target).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    publish.publish({"t": (spark.range(9), target)})
    assert spark.read.parquet(target).count() == 9


def test_clean_csv_round_trip(spark, eight, tmp_path):
    from tidelog.sources import files

    publish.write_csv(eight, str(tmp_path / "c"), single_file=True)
    assert sorted(map(tuple, files.read_clean_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, eight.collect()))


def test_streaming_counts(spark, tmp_path):
    from tidelog.sources.schema import RAW
    from tidelog.streaming.live import hourly_counts

    rows = [("2024-06-01 10", "1", "1", "1", "1"), ("2024-06-01 10", "1", "1", "1", "4"), ("2024-06-01 11", "2", "1", "1", "9")]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))
    query = hourly_counts(source).writeStream.outputMode("complete").format("memory").queryName("live").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [(r.total_count, r.buy_count) for r in spark.table("live").collect()] == [(2, 1)]


def test_save_modes(spark, tmp_path):
    path = str(tmp_path / "p")
    publish.write_parquet(spark.range(2), path)
    publish.write_parquet(spark.range(5), path, mode="skip")
    assert spark.read.parquet(path).count() == 2
    publish.write_parquet(spark.range(5), path, mode="append")
    publish.write_csv(spark.range(3), str(tmp_path / "c"), single_file=True)
    assert spark.read.parquet(path).count() == 7
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
