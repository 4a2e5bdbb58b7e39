import json

import pytest

from tidelog.operators import cleaning
from tidelog.plans import jobs
from tidelog.sources import files
from tidelog.sources.schema import RAW_COLUMNS, SchemaError

SAMPLE = """time,user_id,item_id,item_category,behavior_type
2024-03-07 09,41,700,31,3
2024-03-07 09,41,700,31,3
2024-03-07 09,41,700,31,3
2024-03-07 09,41,700,32,3
2024-03-08 21,42,701,33,4
2024-03-08 22,43,702,33,2
2024-03-09 00,x9,703,34,1
2024-03-09 24,44,704,34,1
yesterday,45,705,35,7
2024-03-10 11,46,706,,1
2024-03-10 12,47,,36,1
2024-03-10 13,,708,36,
"""


def raw(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS))


def write(tmp_path, text, name="raw.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_sample_is_cleaned_and_reported(spark, tmp_path):
    paths = {"report_path": str(tmp_path / "r.json"), "markdown_path": str(tmp_path / "r.md"), "values_output": str(tmp_path / "values")}
    got = jobs.clean_user_behavior(spark, write(tmp_path, SAMPLE), str(tmp_path / "clean"), **paths)
    r = got.report
    assert (r["total_rows"], r["clean_rows"]) == (12, 6)
    assert r["removal_reasons"] == {
        "missing_critical_field": 3,
        "invalid_behavior_type": 1,
        "invalid_id": 1,
        "unparseable_time": 1,
    }
    assert r["counters"]["unparseable_time"] == 2 and r["counters"]["missing_any"] == 3 and r["counters"]["missing_behavior_type"] == 1
    assert r["distinct_ids"] == {"distinct_user_id": 8, "distinct_item_id": 8, "distinct_item_category": 6}
    assert r["behavior_values"] == {"1": 4, "2": 1, "3": 4, "4": 1, "<missing>": 1, "<other>": 1}
    assert {x.value: x.n for x in spark.read.parquet(paths["values_output"]).collect()}["7"] == 1
    assert (r["duplicates"]["full_duplicates"], r["duplicates"]["four_key_duplicates"]) == (2, 3)
    assert r["time_range"] == {"min_time": "2024-03-07 09:00:00", "max_time": "2024-03-10 13:00:00"}
    assert json.loads((tmp_path / "r.json").read_text())["clean_rows"] == 6
    text = (tmp_path / "r.md").read_text()
    assert "| rows removed | 6 |" in text and "| removed, per cent | 50.000000 |" in text and "| invalid_id | 1 |" in text


def test_burst_keeps_the_first_row(spark, tmp_path):
    got = jobs.clean_user_behavior(spark, write(tmp_path, SAMPLE), str(tmp_path / "clean"), suspicious_repeat_threshold=4)
    assert got.rows == 3 and got.report["removal_reasons"]["suspicious_repeat"] == 3
    kept = spark.read.parquet(str(tmp_path / "clean")).where("item_id = 700").collect()
    assert [x.category_id for x in kept] == [31]


def test_first_row_by_file_name_and_place(spark, tmp_path):
    head, row = ",".join(RAW_COLUMNS) + "\n", "2024-05-01 03,8,9,{},1\n"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(head + row.format(1) * 2)
    (folder / "b.csv").write_text(head + row.format(2) * 900)  # the larger file is read first
    got = jobs.clean_user_behavior(spark, str(folder), str(tmp_path / "clean"))
    assert got.rows == 1 and spark.read.parquet(str(tmp_path / "clean")).first().category_id == 1


def test_quotes_are_doubled_and_extra_fields_refused(spark, tmp_path):
    head = ",".join(RAW_COLUMNS) + "\n"
    rows = files.read_raw_csv(spark, write(tmp_path, head + '2024-05-01 03,"1""0","a,b",7\n2024-05-01 03,1,2,3,4\n')).collect()
    assert tuple(rows[0]) == ("2024-05-01 03", '1"0', "a,b", "7", "") and rows[1].behavior_type == "4"
    with pytest.raises(Exception, match="too many fields"):
        files.read_raw_csv(spark, write(tmp_path, head + "2024-05-01 03,1,2,3,4,5\n", "more.csv")).collect()


@pytest.mark.parametrize("n, rows", [(59, 61), (64, 3)])
def test_repeats(spark, tmp_path, n, rows):
    text = ",".join(RAW_COLUMNS) + "\n" + "2024-07-14 05,31,77,4,2\n" * n + "2024-07-14 05,31,77,4,3\n2024-07-15 06,32,78,4,2\n"
    got = jobs.clean_user_behavior(spark, write(tmp_path, text), str(tmp_path / "clean"))
    assert got.rows == rows
    if n == 64:
        assert got.report["bursts"] == {"burst_groups": 1, "burst_rows": 64, "removable_rows": 63, "max_group_rows": 64}


def test_bounds_are_inclusive(spark):
    rows = [(t, "1", "1", "1", "1") for t in ("2024-02-28 22", "2024-02-28 23", "2024-02-29 12", "2024-03-01 00", "2024-03-01 01")]
    a = cleaning.analyse(raw(spark, rows), "2024-02-28 23", "2024-03-01 00")
    assert {r.reason: r.n for r in cleaning.removal_reasons(a).collect()} == {"kept": 3, "out_of_time_range": 2}
    for start, end in (("2024-03-02 00", "2024-03-01 23"), ("2024-3-1 00", None), ("2024-02-30 00", None), (None, "2024-03-01")):
        with pytest.raises(ValueError):
            cleaning.analyse(raw(spark, rows), start, end)


def test_bad_header_leaves_old_output(spark, tmp_path):
    old = tmp_path / "clean"
    spark.range(3).write.parquet(str(old))
    with pytest.raises(SchemaError):
        jobs.clean_user_behavior(spark, write(tmp_path, "wrong,column\n1,2\n"), str(old))
    assert spark.read.parquet(str(old)).count() == 3


def test_header_only_and_bom(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        jobs.clean_user_behavior(spark, write(tmp_path, ",".join(RAW_COLUMNS) + "\n"), str(tmp_path / "a"))
    got = jobs.clean_user_behavior(spark, write(tmp_path, "﻿" + SAMPLE, "bom.csv"), str(tmp_path / "b"))
    assert got.rows == 6


IDS = {
    "1": True,
    "007": True,
    "0": False,
    "+5": False,
    "1.0": False,
    "9223372036854775807": True,
    "9223372036854775808": False,
    " 7\t": True,
    "　8": True,
    "a": False,
    "1\n2": False,
}
TIMES = {"2023-02-28 10": True, "2023-02-29 10": False, "2024-09-06 24": False, "2024-09-06 5": False, "1600-01-01 00": False, " 2024-09-06 05 ": True}


def test_edges(spark):
    for column, cases in (("user_id", IDS), ("time", TIMES), ("behavior_type", {"1": True, "01": False, "5": False, " 4 ": True})):
        base = {"time": "2024-09-06 05", "user_id": "1", "item_id": "1", "item_category": "1", "behavior_type": "1"}
        rows = [tuple((base | {column: v})[c] for c in RAW_COLUMNS) for v in cases]
        a = cleaning.analyse(raw(spark, rows)).collect()
        assert [r.removal_reason is None for r in a] == list(cases.values()), column
        assert all(r.base_valid == (r.removal_reason is None) for r in a)


def test_nulls_count_as_missing(spark):
    a = cleaning.analyse(raw(spark, [(None, None, None, None, None)]))
    assert a.first().removal_reason == "missing_critical_field"
    assert cleaning.clean(a).count() == 0
