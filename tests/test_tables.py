from __future__ import annotations

import pytest
from conftest import TESTDATA

from levelbook.checks.sample import EXCLUDED, sample_tables
from levelbook.operators.filters import FilterSpec, apply_filters
from levelbook.plans import improvement, logins, roster
from levelbook.sources import KEYS, SCHEMAS, JdbcSplit, TableSet, check_keys
from levelbook.sources.tables import broadcast_if_small


def test_schemas():
    assert len(SCHEMAS) == 12
    assert all(key in SCHEMAS[name].names for name, key in KEYS.items())
    assert set(SCHEMAS) - set(KEYS) == {"diagnostic_assessment_students"}


@pytest.fixture
def written(spark, tmp_path):
    """Teachers stored with other column order, types and columns than declared."""
    df = spark.sql("""
        SELECT 'a' AS auth_id, 1 AS id, true AS confirmed, 1L AS active, 1 AS onboarding_completed, 'z' AS extra,
               TIMESTAMP '2024-01-01 10:00:00' AS created_at, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS updated_at""")
    df.write.parquet(str(tmp_path / "teacher.parquet"))
    df.write.parquet(str(tmp_path / "plain" / "teacher"))
    return tmp_path


def test_parquet_is_read_as_declared(spark, written):
    teacher = TableSet.from_parquet(spark, str(written)).table("teacher")
    assert [(f.name, f.dataType) for f in teacher.schema] == [(f.name, f.dataType) for f in SCHEMAS["teacher"]]
    assert logins.logins(TableSet.from_parquet(spark, str(written)), ["b"]).count() == 1
    assert TableSet.from_parquet(spark, str(written / "plain"), "{name}").table("teacher").count() == 1


def test_only_used_columns_are_scanned(spark, written):
    total = logins.onboardings_total(TableSet.from_parquet(spark, str(written)), ["b"])
    plan = total._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<auth_id:string,onboarding_completed:int>" in plan
    assert "EqualTo(onboarding_completed,1)" in plan


def test_filters_of_the_outer_roster_reach_every_scan(spark, make_tables, tmp_path, conf):
    conf(spark__sql__maxMetadataStringLength="1000")
    frames = make_tables()
    for name in ("teacher", "class", "student", "school"):
        frames.table(name).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = roster.teacher_class_student(TableSet.from_parquet(spark, str(tmp_path)), ["x"])
    chosen = apply_filters(rows, [
        FilterSpec("ano_turma", "numeric", lo=2023, hi=2024),
        FilterSpec("estado_escola", "categorical", values=["SP"]),
        FilterSpec("data_cadastro_professor", "datetime", lo="2024-01-01", hi="2024-02-01"),
    ])
    plan = chosen.select("id_professor")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan
    scans = chosen.select("id_professor")._jdf.queryExecution().executedPlan().toString()
    # The rows without a class cannot match, so two of the three parts are left.
    assert scans.count("EqualTo(uf,SP)") == 2
    assert scans.count("GreaterThanOrEqual(year,2023)") == 2
    assert scans.count("LessThanOrEqual(created_at,2024-02-01T00:00)") == 2
    assert "nome_aluno" not in scans and "municipio" not in scans


def test_tables_of_the_catalog(spark, written):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS levelbook_test LOCATION '{written}/db'")
    try:
        spark.read.parquet(str(written / "teacher.parquet")).write.saveAsTable("levelbook_test.teacher")
        tables = TableSet.from_catalog(spark, "levelbook_test")
        assert tables.table("teacher").columns == SCHEMAS["teacher"].names
        assert logins.logins(tables, ["b"]).count() == 1
        assert tables.table("teacher") is tables.table("teacher")
    finally:
        spark.sql("DROP DATABASE levelbook_test CASCADE")


def test_results_go_to_files(spark, tmp_path):
    rows = improvement.class_improvement(sample_tables(spark, TESTDATA), by_month=True, excluded=EXCLUDED)
    rows.write.partitionBy("estado_escola").parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows")).select(*rows.columns)
    assert stored.exceptAll(rows).count() == 0 and stored.count() == rows.count()
    improvement.improvement_kpis(rows).write.option("header", True).csv(str(tmp_path / "kpis"))
    assert spark.read.option("header", True).csv(str(tmp_path / "kpis")).count() == 1


def test_big_jdbc_tables_need_a_split(spark):
    tables = TableSet.from_jdbc(spark, {"url": "jdbc:none"}, {"student": JdbcSplit("id", 0, 9, 3)})
    with pytest.raises(ValueError, match="diagnostic_assessment_students needs a split"):
        tables.table("diagnostic_assessment_students")
    assert JdbcSplit.whole().options() == {}


def test_opening_a_set_applies_the_settings(spark, conf, tmp_path):
    conf(spark__sql__adaptive__forceOptimizeSkewedJoin="false")
    TableSet.from_parquet(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


def test_key_violations(make_tables):
    tables = make_tables(school=[dict(cod_inep=1), dict(cod_inep=1), dict(cod_inep=None)], student=[dict(id=1)])
    found = {r["table"]: (r["repeated_keys"], r["rows_without_key"]) for r in check_keys(tables).collect()}
    assert set(found) == set(KEYS) and found["school"] == (1, 1) and found["student"] == (0, 0)


def test_jdbc_split_options():
    assert JdbcSplit("id", 0, 100, 8).options() == {
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8",
    }


@pytest.mark.parametrize("label,hinted", [("a", True), ("a" * 200, False)])
def test_lookups_are_broadcast_only_if_their_bytes_are_few(spark, conf, label, hinted):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    rows = spark.range(3).selectExpr("CAST(id AS int) AS id", f"'{label}' AS label")
    lookup = broadcast_if_small(rows, 400)
    plan = spark.range(9).join(lookup, "id")._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == hinted
