"""Profiles of loads against the profile of all their rows."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from levelbook.operators.filters import profile_columns
from levelbook.operators.profiles import ProfileStore, load_profile

SCHEMA = "few string, shared string, n long, x double, day date, at timestamp_ntz, flag boolean, `a b` int, gone string"


def rows_of(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [
        (
            rng.choice(["a", "b", None]), f"{seed}-{rng.randint(0, 5)}", rng.randint(-50, 50), rng.choice([None, 0.5, 10.0, 9.0]),
            date(2024, 1, 1) + timedelta(rng.randint(0, 40)), datetime(2024, 1, 1, rng.randint(0, 3)), rng.choice([True, False]),
            rng.choice([9, 10, 100]), None,
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("sizes", [(200, 300), (200, 0), (0, 0), (3, 2, 400), (1,)])
def test_loads_merge_to_the_whole(spark, tmp_path, sizes):
    """``shared`` has few values in each load and many in two; NULL columns and empty loads merge too."""
    store, everything = ProfileStore(spark, f"{tmp_path}/p"), []
    for i, n in enumerate(sizes):
        rows = rows_of(i, n)
        everything += rows
        store.add(spark.createDataFrame(rows, SCHEMA), f"load {i}/x")
    whole = {r["column"]: r for r in profile_columns(spark.createDataFrame(everything, SCHEMA)).collect()}
    merged = {r["column"]: r for r in store.profile().drop("n_estimated").collect()}
    assert merged == whole
    if sizes == (200, 300):
        assert whole["shared"].kind == "text" and whole["few"].kind == "categorical"


def test_a_load_again_takes_the_old_place(spark, tmp_path):
    store = ProfileStore(spark, f"{tmp_path}/p")
    old, new, other = (spark.createDataFrame(rows_of(i, 50), SCHEMA) for i in range(3))
    store.add(old, "1")
    store.add(other, "2")
    store.add(new, "1")
    assert store.profile().drop("n_estimated").collect() == profile_columns(new.union(other)).collect()


def test_estimates_count_a_value_of_two_loads_once(spark, tmp_path):
    store = ProfileStore(spark, f"{tmp_path}/p")
    store.add(spark.range(0, 30_000), "1")
    store.add(spark.range(20_000, 50_000), "2")
    row = store.profile().first()
    assert abs(row.n_estimated - 50_000) < 0.08 * 50_000
    assert (row.kind, row.min, row.max, row.n_distinct) == ("numeric", "0", "49999", None)


def test_a_profile_reads_the_rows_of_loads_only(spark, tmp_path):
    """The kept row of a load is small whatever the load holds, and the new load is all that adding reads."""
    load = spark.range(200_000).selectExpr("id", "cast(id as string) as text")
    row = load_profile(load).first()
    assert sum(len(v) for v in row if isinstance(v, (bytes, bytearray))) < 20_000 and row["id|values"] is None
    store = ProfileStore(spark, f"{tmp_path}/p")
    store.add(load, "1")
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "p").rglob("*.parquet")}
    store.add(spark.range(5).selectExpr("id", "cast(id as string) as text"), "2")
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())
    plan = store.profile()._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and str(tmp_path) in plan
