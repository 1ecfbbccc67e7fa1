"""Large reports piece by piece: rows stay whole, places stay right, and shuffle files do not pile up."""

from __future__ import annotations

import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from test_skew import school

import __spark_entry__ as registry
from levelbook.checks.sample import sample_tables
from levelbook.operators.pages import SortedReport
from levelbook.operators.parts import JoinParts, store_parts
from levelbook.plans import roster


def shuffle_bytes(spark) -> dict[str, int]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def left_behind(spark, before: dict[str, int]) -> int:
    """The bytes of shuffle files that are new since then; their deletion may take a moment."""
    for _ in range(50):
        more = sum(size for name, size in shuffle_bytes(spark).items() if name not in before)
        if more < 4096:
            break
        time.sleep(0.1)
    return more


def data(n=600, seed=6):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [
        (r.choice([7, 7, 7, None, *range(20)]), r.choice([None, start + timedelta(hours=r.randint(0, 90))]),
         r.choice([None, float("nan"), 0.0, -1.5, float("inf")]), f"row {i}")
        for i in range(n)
    ]


ORDERS = {
    "plain": lambda: ["k", "t", "d", "name"],
    "mixed": lambda: [F.desc("k"), F.asc_nulls_last("t"), F.desc_nulls_first("d"), "name"],
    "computed": lambda: [F.date_trunc("day", "t").desc(), F.col("d"), F.lower("name").desc()],
}


@pytest.mark.parametrize("slice_rows", [20, 150, 10_000])
@pytest.mark.parametrize("order", ORDERS)
def test_places_are_those_of_a_sort_in_slices_too(spark, tmp_path, order, slice_rows):
    df = spark.createDataFrame(data(), "k long, t timestamp_ntz, d double, name string").repartition(5)
    expected = [r.name for r in df.sort(*ORDERS[order]()).collect()]
    report = SortedReport.store(df, ORDERS[order](), str(tmp_path / "r"), 4, slice_rows=slice_rows)
    found = report.rows().orderBy("pos").collect()
    assert [r.name for r in found] == expected and [r.pos for r in found] == list(range(1, 601))
    assert [r.name for r in report.page(2, 90).collect()] == expected[180:270]
    assert os.listdir(tmp_path) == ["r"]


def test_a_slice_is_sorted_at_a_time(spark, tmp_path):
    """One value of the first key holds most rows; the further keys cut it."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))
    report = SortedReport.store(df, ["k", "n"], str(tmp_path / "r"), 1, slice_rows=300)
    sizes = [b - a for a, b in zip(report._starts, report._starts[1:], strict=False)]
    assert sum(sizes) == 3000 and len(sizes) > 6 and max(sizes) < 900


def test_no_rows_in_slices(spark, tmp_path):
    report = SortedReport.store(spark.createDataFrame([], "a long"), ["a"], str(tmp_path / "r"), slice_rows=10)
    assert len(report) == 0 and report.rows().collect() == []


@pytest.mark.parametrize("part_levels", [100, 10**6])
def test_the_pairing_in_parts_is_the_pairing(make_tables, monkeypatch, tmp_path, part_levels):
    monkeypatch.setattr(roster, "staged_path", lambda spark, name: str(tmp_path / name))
    t = school(make_tables)
    plain = roster.students_by_class(t)
    counts = []

    def store(parts):
        counts.append(len(parts))
        return store_parts(parts, str(tmp_path / "pairing"))

    stored = roster.students_by_class(t, store=store, part_levels=part_levels, pairs_per_task=50)
    assert counts == [12 if part_levels == 100 else 1] and stored.dtypes == plain.dtypes
    assert Counter(map(tuple, stored.collect())) == Counter(map(tuple, plain.collect()))
    assert os.listdir(tmp_path) == ["pairing"]


def test_parts_without_rows(spark, tmp_path):
    left = spark.createDataFrame([(None, 1), (2, 5)], "k long, a long")
    right = spark.createDataFrame([(None, 1), (3, 5)], "k long, b long")
    parts = JoinParts(left, right, "k", lambda a, b: a.join(b, "k"), 3, str(tmp_path / "sides"))
    stored = store_parts(parts, str(tmp_path / "joined"))
    assert stored.collect() == [] and stored.columns == ["k", "a", "b"]


def test_the_sorted_pairing_in_parts_and_slices(spark):
    t = sample_tables(spark, TESTDATA)
    order = [F.desc("data_criacao_avaliacao"), "id_avaliacao", "id_aluno", "hipotese"]
    expected = [tuple(r) for r in roster.students_by_class(t).sort(*order).collect()]
    sorted_rows = roster.students_by_class(
        t, part_levels=len(expected) // 8, store=lambda parts: registry._in_order(parts, *order, slice_rows=len(expected) // 5)
    )
    found = sorted((r.pos, tuple(r)[:-1]) for r in sorted_rows.collect())
    assert [row for _, row in found] == expected and [p for p, _ in found] == list(range(1, len(expected) + 1))


def test_the_sorted_pairing_leaves_no_shuffle_files(spark):
    before = shuffle_bytes(spark)
    rows = registry.queries()["pairing_sorted"](spark, TESTDATA)
    # The counts of a few ranges may stay.
    assert left_behind(spark, before) < 4096 and rows.columns[-1] == "pos"


def test_the_types_of_the_pairing_are_told_from_stored_rows(spark):
    """Its joins run once, not for the types and again for the rows."""
    before = shuffle_bytes(spark)
    rows = registry.queries()["format_integers"](spark, TESTDATA)
    assert left_behind(spark, before) < 4096
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {dict(rows.dtypes)[c] for c in registry._TEXT_IDS} == {"bigint"}
