"""Hot keys: results stay whole, and the work of a hot key is split."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import SMALL_SKEW
from pyspark.sql import functions as F

from levelbook.operators.skew import HOT_ROWS, HotChunks, fan_out_join, row_numbered
from levelbook.plans import levels, roster


def final_plan(df) -> str:
    """The plan as it was executed."""
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]


def keyed(spark, n, hot_share, name, keys=20, seed=1):
    r = random.Random(seed)
    rows = [(0 if r.random() < hot_share else r.choice([None, *range(1, keys)]), i) for i in range(n)]
    return spark.createDataFrame(rows, f"k long, {name} long")


@pytest.mark.parametrize("pairs", [1, 7, 100, 10_000, 10**9])
@pytest.mark.parametrize("left_hot,right_hot", [(0.4, 0.4), (0.8, 0.0), (0.0, 0.8)])
def test_fan_out_join_is_the_plain_join(spark, pairs, left_hot, right_hot):
    left, right = keyed(spark, 120, left_hot, "a"), keyed(spark, 150, right_hot, "b", seed=2)
    plain = left.join(right, "k")
    cut = fan_out_join(left, right, "k", pairs_per_task=pairs)
    assert cut.columns == plain.columns
    assert Counter(map(tuple, cut.collect())) == Counter(map(tuple, plain.collect()))


def test_fan_out_join_spreads_a_hot_key(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false")
    left, right = keyed(spark, 400, 0.9, "a"), keyed(spark, 600, 0.9, "b", seed=2)

    def pairs_per_task(df):
        parts = df.select(F.spark_partition_id().alias("p"), "k").filter("k = 0").groupBy("p").count()
        return [r["count"] for r in parts.collect()]

    assert len(pairs_per_task(left.join(right, "k"))) == 1
    spread = pairs_per_task(fan_out_join(left, right, "k", pairs_per_task=2000))
    assert len(spread) == 4 and max(spread) < 0.5 * sum(spread)


def test_rough_counts_only_size_the_slices(spark):
    left, right = keyed(spark, 100, 0.5, "a"), keyed(spark, 100, 0.5, "b", seed=2)
    guess = spark.createDataFrame([(0,)] * 50 + [(5,)] * 50, "k long")
    cut = fan_out_join(left, right, "k", left_rows=guess, right_rows=guess, pairs_per_task=30)
    assert Counter(map(tuple, cut.collect())) == Counter(map(tuple, left.join(right, "k").collect()))


def brute_numbers(rows, order):
    """Row numbers by plain Python; equal rows may take each other's place."""
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    numbered = []
    for group in groups.values():
        group.sort(key=lambda row: [(row[i] is not None, row[i] or 0) for i in order])
        numbered += [(*row, i) for i, row in enumerate(group, 1)]
    return Counter(numbered)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_row_numbers_of_a_hot_group(spark, conf, size):
    conf(spark__sql__shuffle__partitions="6", spark__sql__adaptive__coalescePartitions__enabled="false")
    r = random.Random(3)
    # Half of the rows in one group, a third of all rows copies of one row, some NULL groups.
    rows = [(0, 5, 5)] * 200 + [
        (r.choice([0, 0, 0, 1, 2, 3, None]), r.choice([None, *range(8)]), r.randint(0, 3)) for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "g long, t long, u long").repartition(5)
    numbered = row_numbered(df, ["g"], ["t", "u"], F.floor(F.col("t") / size))
    assert numbered.columns == ["g", "t", "u", "rn"]
    assert Counter(map(tuple, numbered.collect())) == brute_numbers(rows, (1, 2))


def test_a_hot_group_is_spread_over_tasks(spark, conf):
    conf(spark__sql__shuffle__partitions="8", spark__sql__adaptive__coalescePartitions__enabled="false",
         spark__sql__autoBroadcastJoinThreshold="-1")
    df = spark.range(4000).select(F.lit(1).alias("g"), (F.col("id") % 40).alias("t"))
    numbered = row_numbered(df, ["g"], ["t"], F.col("t"))
    parts = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 3 and max(p["count"] for p in parts) < 2500
    assert sorted(r.rn for r in numbered.collect()) == list(range(1, 4001))


@pytest.mark.parametrize("hot_rows,most,fan", [(10, 1024, 16), (10, 1, 3), (100, 2, 2), (10**9, 1024, 16)])
def test_hot_groups_are_found_and_cut_by_the_data(spark, conf, hot_rows, most, fan):
    conf(spark__sql__shuffle__partitions="6", spark__sql__adaptive__coalescePartitions__enabled="false")
    r = random.Random(8)
    rows = [(0, 5, 5)] * 50 + [
        (r.choice([0, 0, 0, 1, 2, 3, None, None]), r.choice([None, *range(300)]), r.randint(0, 3)) for _ in range(500)
    ]
    df = spark.createDataFrame(rows, "g long, t long, u long").repartition(5)
    numbered = row_numbered(df, ["g"], ["t", "u"], HotChunks(df.select("g"), df.select("t"), hot_rows, most, fan))
    assert numbered.columns == ["g", "t", "u", "rn"]
    assert Counter(map(tuple, numbered.collect())) == brute_numbers(rows, (1, 2))


def test_a_hot_group_of_one_month_is_spread_and_its_rows_are_computed_once(spark, conf, tmp_path):
    conf(spark__sql__shuffle__partitions="8", spark__sql__adaptive__coalescePartitions__enabled="false",
         spark__sql__autoBroadcastJoinThreshold="-1")
    start = datetime(2024, 3, 1)
    spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("g"),
        F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit(start)).alias("t"),
    ).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    numbered = row_numbered(df, ["g"], ["t"], HotChunks(df.select("g"), df.select("t"), hot_rows=1000))
    parts = numbered.filter("g = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(p["count"] for p in parts) < 2000
    assert sorted(r.rn for r in numbered.filter("g = 1").collect()) == list(range(1, 4001))
    plan = final_plan(numbered)
    # The rows are scanned once for both branches; the hot groups and the bounds take a column each.
    assert "ReusedExchange" in plan and plan.count("ReadSchema: struct<g:bigint,t:") == 1


def test_building_the_history_starts_no_job(spark, make_tables):
    t = school(make_tables, n=20)
    levels.hypothesis_history(t)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("history", "building a plan")
    try:
        levels.hypothesis_history(t)
        assert not tracker.getJobIdsForGroup("history")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def school(make_tables, n=300, hot=0.5, seed=5):
    """One teacher, class and student that hold about half of everything below them."""
    r = random.Random(seed)
    start = datetime(2024, 1, 1)

    def pick(keys):
        return keys[0] if r.random() < hot else r.choice(keys)

    teachers, classes, students, assessments = range(1, 9), range(1, 31), range(1, n), range(1, 90)
    return make_tables(
        teacher=[dict(id=i, auth_id=str(i + 100), onboarding_completed=1, created_at=start) for i in teachers],
        **{"class": [dict(id=i, teacher_id=pick(teachers), name=f"T{i}", year=2024, cod_inep=pick([1, 2, 3, None])) for i in classes]},
        student=[dict(id=i, class_id=pick(classes), name=f"A{i}") for i in students],
        school=[dict(cod_inep=i, name=f"E{i}", municipio="M", uf=f"U{i}") for i in (1, 2, 3)],
        diagnostic_assessment=[dict(id=i, teacher_id=pick(teachers), class_id=pick(classes), month="3", created_at=start + timedelta(days=i % 7)) for i in assessments],
        diagnostic_assessment_type_hypothesis=[dict(id=i, name=f"N{i}", ordering=i) for i in range(1, 6)],
        diagnostic_assessment_students=[
            dict(student_id=pick(students), diagnostic_assessment_id=pick(assessments), hypothesis_id=r.randint(1, 5), comment=str(i % 3))
            for i in range(4 * n)
        ],
    )


@pytest.mark.parametrize("hot_rows", [20, HOT_ROWS])
def test_history_of_a_hot_student(make_tables, hot_rows):
    t = school(make_tables)
    rows = levels.hypothesis_history(t, hot_rows=hot_rows).collect()
    numbers = {}
    for r in rows:
        numbers.setdefault(r.student_id, []).append((r.rn, r.created_at))
    for found in numbers.values():
        assert [rn for rn, _ in sorted(found)] == list(range(1, len(found) + 1))
        assert [at for _, at in sorted(found)] == sorted(at for _, at in found)


def test_pairs_of_a_hot_class(make_tables):
    t = school(make_tables)
    plain = Counter(map(tuple, roster.students_by_class(t).collect()))
    assert Counter(map(tuple, roster.students_by_class(t, pairs_per_task=50).collect())) == plain


def test_a_hot_class_of_the_roster_is_split(make_tables, conf):
    """Also in the outer roster, and also under an aggregate that could reuse the join's partitioning."""
    t = school(make_tables, n=4000, hot=0.6)
    expected = Counter(map(tuple, roster.teacher_class_student(t, []).collect()))
    conf(**SMALL_SKEW)
    rows = roster.teacher_class_student(t, [])
    assert "skew=true" in final_plan(rows)
    assert Counter(map(tuple, rows.collect())) == expected
    by_state = roster.classes_by_state(roster.teacher_class_student(t, []))
    assert "skew=true" in final_plan(by_state)
