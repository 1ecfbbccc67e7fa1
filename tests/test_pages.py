"""Sorted reports: every row has its place, pages are parts of it, and no task sorts everything."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from levelbook.checks.sample import EXCLUDED, sample_tables
from levelbook.operators.pages import SortedReport
from levelbook.plans import roster
from levelbook.sources.staging import remove, staged_path


def rows(n=500, seed=1):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    # One key holds half of the rows; keys may be missing.
    return [
        (r.choice([7, 7, 7, None, *range(20)]), r.choice([None, start + timedelta(days=r.randint(0, 9))]), f"row {i}")
        for i in range(n)
    ]


def by_key(row):
    return [(v is not None, v) if v is not None else (False,) for v in row]


@pytest.mark.parametrize("ranges", [1, 3, 16, None])
def test_places_are_those_of_a_sort(spark, tmp_path, ranges):
    data = rows()
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, name string").repartition(5)
    report = SortedReport.store(df, ["k", "t", "name"], str(tmp_path / "r"), ranges)
    found = sorted((r.pos, (r.k, r.t, r.name)) for r in report.rows().collect())
    assert [p for p, _ in found] == list(range(1, 501)) and len(report) == 500
    assert [row for _, row in found] == sorted(data, key=by_key)


def test_descending_keys_and_pages(spark, tmp_path):
    data = rows(333, seed=2)
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, name string").repartition(4)
    report = SortedReport.store(df, [F.desc("k"), "name"], str(tmp_path / "r"), 6)
    expected = sorted(data, key=lambda row: (row[0] is None, -(row[0] or 0), row[2]))
    for number in range(5):
        page = report.page(number, 100).collect()
        assert [tuple(r)[:3] for r in page] == expected[number * 100:(number + 1) * 100]
        assert [r.pos for r in page] == list(range(number * 100 + 1, min(333, number * 100 + 100) + 1))
    again = SortedReport(spark, report.path)
    assert len(again) == 333 and again.page(3, 100).count() == 33
    scan = report.page(1, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_at," in scan  # a page is found by what the files are sorted by


def test_a_hot_key_is_cut_by_the_further_keys(spark, tmp_path):
    df = spark.range(20000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))
    report = SortedReport.store(df, ["k", "n"], str(tmp_path / "r"), 8)
    sizes = [b - a for a, b in zip(report._starts, report._starts[1:], strict=False)]
    assert sum(sizes) == 20000 and max(sizes) < 5000


def test_empty_reports(spark, tmp_path):
    report = SortedReport.store(spark.createDataFrame([], "a long"), ["a"], str(tmp_path / "r"))
    assert len(report) == 0 and report.rows().collect() == [] and report.page(0, 5).collect() == []
    assert report.rows().columns == ["a", "pos"]


def test_no_window_over_the_report(spark):
    people = roster.teacher_class_student(sample_tables(spark, TESTDATA), EXCLUDED)
    path = staged_path(spark, "sorted")
    report = SortedReport.store(people, roster.ROSTER_KEYS, path)
    plan = report.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "SinglePartition" not in plan
    first = report.page(0, 50).drop("pos").collect()
    assert first == people.orderBy(*roster.ROSTER_KEYS).limit(50).collect()
    remove(spark, path)
