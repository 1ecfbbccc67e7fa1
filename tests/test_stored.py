"""Bucketed copies, results kept up to date, figures taken while writing, and reads at key ranges."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from test_skew import school

from levelbook.checks.sample import EXCLUDED, sample_tables
from levelbook.plans import improvement, levels, logins
from levelbook.plans.refresh import ImprovementStore
from levelbook.sources import TableSet
from levelbook.sources.ranges import KeyRanges
from levelbook.sources.stored import store_tables, write_with_figures

LEVELS = "diagnostic_assessment_students"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_students_meet_their_levels_without_a_shuffle(spark, tmp_path):
    tables = sample_tables(spark, TESTDATA)
    spark.sql(f"CREATE DATABASE levelbook_buckets LOCATION '{tmp_path}/db'")
    try:
        stored = store_tables(tables, spark, "levelbook_buckets", buckets=5)
        evolution = levels.student_evolution(stored)
        plan = evolution._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Bucketed: true" in plan
        assert rows_of(evolution) == rows_of(levels.student_evolution(tables))
        for by_month in (False, True):
            found = improvement.class_improvement(stored, by_month=by_month)
            assert rows_of(found) == rows_of(improvement.class_improvement(tables, by_month=by_month))
        total = improvement.class_improvement(stored)._jdf.queryExecution().executedPlan().toString()
        # The one shuffle that is left adds up the classes.
        assert total.count("hashpartitioning(student_id") == total.count("hashpartitioning(id#") == 0
    finally:
        spark.sql("DROP DATABASE levelbook_buckets CASCADE")


def cut(tables: TableSet, rows):
    return TableSet(lambda name: rows if name == LEVELS else tables.table(name))


@pytest.mark.parametrize("options", [{}, {"by_month": True}, {"by_month": True, "denominator": "assessed", "excluded": ["103"]}])
def test_refreshed_equals_computed_again(spark, make_tables, tmp_path, options):
    tables = school(make_tables, n=200)
    marked = tables.table(LEVELS).withColumn("_n", F.monotonically_increasing_id()).persist()
    parts = [marked.filter(F.pmod(F.xxhash64("_n"), F.lit(4)) == i).drop("_n") for i in range(4)]
    store = ImprovementStore(spark, str(tmp_path / "store"), parts=3, **options)
    store.build(cut(tables, parts[0]))
    so_far = parts[0]
    for part in parts[1:]:
        so_far = so_far.unionByName(part)
        now = cut(tables, so_far)
        store.refresh(now, part)
        assert rows_of(store.report()) == rows_of(improvement.class_improvement(now, **options))
    store.refresh(now, part)  # a refresh that is repeated changes nothing
    assert rows_of(store.report()) == rows_of(improvement.class_improvement(tables, **options))
    store.refresh(now, part.filter("false"))
    assert rows_of(store.report()) == rows_of(improvement.class_improvement(tables, **options))
    marked.unpersist()


def test_new_students_change_the_size_of_their_class(spark, make_tables, tmp_path):
    def now(students):
        return make_tables(
            teacher=[dict(id=1, auth_id="a")], **{"class": [dict(id=i, teacher_id=1, name=f"T{i}") for i in (1, 2)]},
            student=[dict(id=i, class_id=1 + i % 2) for i in range(students)],
            diagnostic_assessment_type_hypothesis=[dict(id=i, ordering=i) for i in (1, 2)],
            diagnostic_assessment_students=[dict(student_id=i, hypothesis_id=h) for i in (1, 2) for h in (1, 2)],
        )

    store = ImprovementStore(spark, str(tmp_path / "store"))
    store.build(now(4))
    later = now(7)
    store.refresh(later, later.table(LEVELS).filter("false"), later.table("student").filter("id >= 4"))
    assert rows_of(store.report()) == rows_of(improvement.class_improvement(later))


def test_a_refresh_leaves_other_parts_alone(spark, make_tables, tmp_path):
    tables = school(make_tables, n=200, hot=0.1)
    store = ImprovementStore(spark, str(tmp_path / "store"), parts=16)
    store.build(tables)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    store.refresh(tables, tables.table(LEVELS).filter("student_id = 17"))
    same = [p for p, at in files.items() if p.exists() and p.stat().st_mtime_ns == at]
    assert len(same) >= len(files) - 2 * 4 and len(same) > 20
    assert rows_of(store.report()) == rows_of(improvement.class_improvement(tables))


def test_figures_of_the_job_that_writes(spark, tmp_path):
    rows = logins.logins(sample_tables(spark, TESTDATA), EXCLUDED)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("written", "one write")
    try:
        figures = write_with_figures(rows, str(tmp_path / "logins"), {
            "total_logins": F.count("id_professor"), "total_onboardings": F.count_if(F.col("onboarding_completo") == 1),
        })
        assert len(tracker.getJobIdsForGroup("written")) <= 2
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert figures == logins.login_kpis(rows).first().asDict()
    assert spark.read.parquet(str(tmp_path / "logins")).count() == figures["total_logins"]


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_key_ranges_hold_equal_shares(partitions):
    r = random.Random(3)
    # A dense stretch, a gap, a sparse stretch, negative and missing keys.
    keys = [*range(5000), *(10**9 + 997 * i for i in range(1500)), *(-r.randint(1, 10**6) for _ in range(500)), None, None]
    database = duckdb.connect()
    database.execute("CREATE TABLE student (id BIGINT)")
    database.executemany("INSERT INTO student VALUES (?)", [[k] for k in keys])
    ranges = KeyRanges("id", 50, partitions)
    histogram = database.execute(ranges.histogram_query("student")).fetchall()
    predicates = ranges.predicates(histogram)
    assert len(predicates) <= partitions
    sizes = [database.execute(f"SELECT count(*) FROM student WHERE {p}").fetchone()[0] for p in predicates]
    met = database.execute("SELECT " + " + ".join(f"coalesce(CAST(({p}) AS INT), 0)" for p in predicates) + " AS n, count(*) FROM student GROUP BY 1").fetchall()
    assert met == [(1, len(keys))]
    assert max(sizes) <= len(keys) / partitions + 60 and sum(sizes) == len(keys)


def test_key_ranges_of_small_and_uneven_tables():
    assert KeyRanges("id", 10, 4).predicates([]) == ["1 = 1"]
    assert KeyRanges("id", 10, 4).predicates([(3, 100)]) == ["1 = 1"]
    assert KeyRanges("id", 10, 3).predicates([(0, 1000), (1, 1), (2, 1)]) == [
        "id < 10 OR id IS NULL", "id >= 10 AND id < 20", "id >= 20",
    ]
