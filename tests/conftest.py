from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from levelbook.sources import SCHEMAS, TableSet, tuned  # noqa: E402

# No broadcasts, and partitions of a few kilobytes already count as skewed.
SMALL_SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4k",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4k",
    "spark__sql__shuffle__partitions": "8",
}

TESTDATA = os.environ.get("LEVELBOOK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("levelbook-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tuned(session)
    session.stop()


@pytest.fixture
def make_tables(spark):
    """Tables from short rows: ``make_tables(student=[dict(id=1)])``; what is not given is NULL or empty."""
    def make(**rows: list[dict]) -> TableSet:
        def frame(name: str):
            columns = SCHEMAS[name].names
            unknown = {key for row in rows.get(name, []) for key in row} - set(columns)
            assert not unknown, f"{name} has no column {unknown}"
            data = [tuple(row.get(c) for c in columns) for row in rows.get(name, [])]
            return spark.createDataFrame(data, SCHEMAS[name])

        assert set(rows) <= set(SCHEMAS)
        return TableSet.from_frames({name: frame(name) for name in SCHEMAS})

    return make


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def set_conf(**settings: str) -> None:
        for name, value in settings.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_conf
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def duck(directory: str | None = None) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    if directory:
        for file in sorted(os.listdir(directory)):
            name = file.removesuffix(".parquet")
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{file}'")
    return connection


def _plain(value):
    if value is None or value != value:
        return None
    return value


def rows_of(names, tuples) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in tuples]
    return sorted(plain, key=lambda row: [(v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row])


def spark_rows(df) -> list[tuple]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql: str) -> list[tuple]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    return rows_of(names, result.fetchall())
