from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from levelbook.operators.cleaning import fill_null_numeric, ids_as_text, infer_dates, normalize_ints, strip_tz
from levelbook.operators.filters import (
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    TEXT,
    FilterSpec,
    apply_filters,
    filter_facets,
    profile_columns,
    state_filter,
)


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [
            (1, "SP", 1.5, datetime(2024, 1, 5), "a.b"),
            (2, "SP", 2.5, datetime(2024, 1, 6, 12), "axb"),
            (3, "AC", None, datetime(2024, 1, 7, 0, 0, 0, 1), None),
            (4, None, 4.0, None, "A.B"),
        ],
        "id long, uf string, x double, t timestamp_ntz, s string",
    )


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("values,expected", [
    (["SP"], [1, 2]), (["SP", None], [1, 2, 4]), ([None], [4]), ([float("nan"), "AC"], [3, 4]), ([], []), (["AC", "SP"], [1, 2, 3]), (["ZZ"], []),
    (None, [1, 2, 3, 4]),
])
def test_chosen_values(people, values, expected):
    assert ids(apply_filters(people, [FilterSpec("uf", CATEGORICAL, values=values)])) == expected


@pytest.mark.parametrize("lo,hi,expected", [(1, None, [1, 2, 3, 4]), (None, 1, [0, 1]), (None, None, [0, 1, 2, 3, 4]), (2, 3, [2, 3])])
def test_open_ranges(spark, lo, hi, expected):
    assert ids(apply_filters(spark.range(5), [FilterSpec("id", NUMERIC, lo=lo, hi=hi)])) == expected


@pytest.mark.parametrize("states,expected", [
    (["Todos"], [1, 2, 3, 4]), (["AC", "Todos"], [1, 2, 3, 4]), ([], []), (["AC"], [3]), ([None], [4]),
])
def test_states(people, states, expected):
    assert ids(state_filter(people, states, column="uf")) == expected


def test_number_range_includes_both_ends(people):
    assert ids(apply_filters(people, [FilterSpec("x", NUMERIC, lo=1.5, hi=2.5)])) == [1, 2]


@pytest.mark.parametrize("lo,hi,whole,expected", [
    (date(2024, 1, 5), date(2024, 1, 6), False, [1]),
    (date(2024, 1, 5), date(2024, 1, 6), True, [1, 2]),
    (date(2024, 1, 5), date(2024, 1, 7), False, [1, 2]),
    ("2024-01-06", "2024-01-07", True, [2, 3]),
    (date(2024, 1, 6), None, False, [1, 2, 3, 4]),
    (datetime(2024, 1, 5, 9), datetime(2024, 1, 6, 23), False, [1]),
])
def test_dates_end_at_midnight(people, lo, hi, whole, expected):
    assert ids(apply_filters(people, [FilterSpec("t", DATETIME, lo=lo, hi=hi, whole_day=whole)])) == expected


@pytest.mark.parametrize("column,pattern,expected", [
    ("s", "a.b", [1, 2]), ("s", r"a\.b", [1]), ("s", "", [1, 2, 3, 4]), ("s", "None", []), ("id", "^[13]$", [1, 3]), ("s", "B$", [4]),
])
def test_text_is_a_case_sensitive_pattern(people, column, pattern, expected):
    assert ids(apply_filters(people, [FilterSpec(column, TEXT, pattern=pattern)])) == expected


def test_filters_chain(people):
    specs = [FilterSpec("uf", CATEGORICAL, values=["SP", None]), FilterSpec("x", NUMERIC, lo=2, hi=4)]
    assert ids(apply_filters(people, specs)) == [2, 4]
    with pytest.raises(ValueError):
        apply_filters(people, [FilterSpec("uf", "other")])


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("s")).write.parquet(path)
    df = apply_filters(spark.read.parquet(path).select("id", "s"), [
        FilterSpec("id", NUMERIC, lo=5, hi=7), FilterSpec("s", CATEGORICAL, values=["1"]),
    ])
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(id,5)" in pushed and "EqualTo(s,1)" in pushed


def profile(df, **options):
    return {r.column: r for r in profile_columns(df, **options).collect()}


def test_profile_kinds_and_bounds(spark):
    df = spark.range(1000).select(
        "id",
        (F.col("id") % 9).alias("nine"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 11).alias("ten"),
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), F.col("id") % 10)).alias("gaps"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
        F.lit(None).cast("string").alias("empty"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=F.col("id").cast("int"))).alias("t"),
    )
    found = profile(df)
    assert {c: r.kind for c, r in found.items()} == {
        "id": NUMERIC, "nine": CATEGORICAL, "ten": NUMERIC, "gaps": CATEGORICAL, "text": TEXT, "empty": CATEGORICAL, "t": DATETIME,
    }
    assert found["nine"].values == [str(i) for i in range(9)] and found["nine"].n_distinct == 9
    assert found["gaps"].has_null and not found["nine"].has_null and len(found["gaps"].values) == 9
    assert found["empty"].values == [] and found["empty"].has_null
    assert (found["id"].min, found["id"].max, found["id"].step) == ("0", "999", 9.99)
    assert found["ten"].n_distinct is None and found["ten"].values is None and found["ten"].step == 0.09
    assert found["t"].min.startswith("2024-01-01") and found["t"].step is None
    exact = profile(df, exact_counts=True)
    assert {c: r.n_distinct for c, r in exact.items()} == {
        "id": 1000, "nine": 9, "ten": 10, "gaps": 9, "text": 1000, "empty": 0, "t": 1000,
    }
    assert {c: r.kind for c, r in exact.items()} == {c: r.kind for c, r in found.items()}


@pytest.mark.parametrize("n", [1, 9, 10, 11, 20, 21, 60, 200])
def test_the_limit_is_exact(spark, n):
    df = spark.range(3000).select((F.col("id") % n).alias("c"))
    assert profile(df)["c"].kind == (CATEGORICAL if n < 10 else NUMERIC)
    assert profile(df, max_values=1000)["c"].kind == CATEGORICAL
    assert profile(df, max_values=60)["c"].kind == (CATEGORICAL if n < 60 else NUMERIC)


def test_profile_of_nothing(spark):
    found = profile(spark.createDataFrame([], "a long, b string"))
    assert {c: r.kind for c, r in found.items()} == {"a": CATEGORICAL, "b": CATEGORICAL}
    assert profile(spark.range(30).select("id", F.lit(1).alias("one")), columns=["one"]).keys() == {"one"}


def test_whole_numbers_become_integers(spark):
    df = spark.createDataFrame(
        [(1.0, 1.5, None, 1e300, float("nan"), 7), (2.0, 2.0, None, 1.0, 1.0, 8), (None, 3.0, None, 1.0, 1.0, None)],
        "a double, b double, c double, d double, e double, f int",
    )
    fixed = normalize_ints(df)
    assert dict(fixed.dtypes) == dict(a="bigint", b="double", c="double", d="double", e="double", f="int")
    assert [r.a for r in fixed.collect()] == [1, 2, None]


def test_missing_numbers_become_zero(people):
    fixed = fill_null_numeric(people)
    assert [r.x for r in fixed.orderBy("id").collect()] == [1.5, 2.5, 0.0, 4.0]
    assert fixed.filter(F.col("uf").isNull()).count() == 1


def test_date_texts(spark):
    df = spark.createDataFrame(
        [("2024/03", "2024/03/05", "2024/03", "2024/13", "ano 2024/03", "x", "2024/03"), (None, "2024/12/31", "2024/03/01", "2024/01", "2024/04", "y", "abc")],
        "month string, day string, mixed string, wrong string, words string, text string, partly string",
    )
    fixed = infer_dates(df)
    assert [name for name, kind in fixed.dtypes if kind == "timestamp_ntz"] == ["month", "day"]
    assert fixed.first().month == datetime(2024, 3, 1) and fixed.first().day == datetime(2024, 3, 5)


def test_zones_and_ids(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 10:00:00' AS t, 1234567L AS id")
    assert dict(strip_tz(df).dtypes)["t"] == "timestamp_ntz"
    assert strip_tz(df).first().t == datetime(2024, 1, 1, 10)
    assert ids_as_text(df, ["id"]).first().id == "1234567"


def described(rows, column, drop=("place", "rows")):
    return [{k: v for k, v in r.asDict().items() if k not in drop} for r in rows if r["column"] == column]


def test_facets_are_profiles_of_the_rows_filtered_so_far(people):
    chain = [
        FilterSpec("uf", CATEGORICAL, values=["SP", None]),
        FilterSpec("x", NUMERIC),
        FilterSpec("id", NUMERIC, lo=2),
        FilterSpec("s", TEXT, pattern="^[aA]"),
        FilterSpec("uf", CATEGORICAL, values=[]),
        FilterSpec("t", DATETIME),
    ]
    for limit in (2, 10):
        found = filter_facets(people, chain, limit).collect()
        assert [r.place for r in found] == [1, 2, 3, 4, 5, 6]
        for i, spec in enumerate(chain):
            rows = apply_filters(people, chain[:i])
            assert found[i].rows == rows.count()
            assert described(found[i:i + 1], spec.column) == described(profile_columns(rows, limit).collect(), spec.column)


def test_facets_read_the_rows_once_and_start_no_job(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 12).withColumn("few", F.col("id") % 3)
    chain = [FilterSpec("few", CATEGORICAL, values=[0, 1]), FilterSpec("k", NUMERIC, lo=3), FilterSpec("k", NUMERIC, hi=9)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("facets", "building a plan")
    try:
        facets, profile = filter_facets(rows, chain), profile_columns(rows)
        assert not tracker.getJobIdsForGroup("facets")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    for df in (facets, profile):
        assert df._jdf.queryExecution().executedPlan().toString().count("Range (0, 1000") == 1
    first, second, third = facets.collect()
    assert first["values"] == ["0", "1", "2"] and first.rows == 1000
    assert (second.kind, second["values"], second.rows) == (CATEGORICAL, ["0", "1", "3", "4", "6", "7", "9", "10"], 667)
    assert (third.min, third.max, third.n_distinct) == ("3", "10", 6)


@pytest.mark.parametrize("n", [9, 10, 11, 19, 25, 200, 400, 5000])
def test_the_limit_of_values_is_exact(spark, n):
    rows = spark.range(20000).select((F.col("id") % n).alias("k"), F.concat(F.lit("v"), F.col("id") % n).alias("s"))
    found = {r["column"]: r for r in profile_columns(rows).collect()}
    assert (found["k"].kind == CATEGORICAL) == (found["s"].kind == CATEGORICAL) == (n < 10)
    assert found["s"].n_distinct == (n if n < 10 else None)
