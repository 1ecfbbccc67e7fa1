"""Every registered query on the whole test tables: its plan, its rows, and known figures."""

from __future__ import annotations

import re

import pytest
from conftest import TESTDATA, duck, duck_rows, spark_rows

import __spark_entry__ as registry

# Row counts and values published with the test mapping, for sf0.001.
ROWS = {
    "logins": 143, "students_by_class": 18637, "student_evolution": 665, "evolved_students_distinct": 665,
    "teachers_multi_class": 100, "classes_multi_assessment": 1322, "hypothesis_history": 5321,
    "class_improvement_total": 477, "questionnaire_answers": 445, "answered_all": 430, "answered_partly": 15,
    "teacher_class_student": 4303, "registered_classes": 3927, "class_improvement_by_month": 534,
    "class_improvement_by_month_assessed": 534, "state_choices": 27,
}
VALUES = {
    "onboardings_total": dict(total_onboardings=85),
    "students_total": dict(total_students=4221),
    "diagnostics_total": dict(total_diagnosis=5130),
    "classes_total": dict(total_classes=1500),
    "evolved_students_count": dict(total_students_with_evolution=665),
    "login_kpis": dict(total_logins=143, total_onboardings=85),
    "questionnaire_kpis": dict(total_professores=123, total_professores_n=15),
    "teacher_kpis": dict(total_professores=143, total_turmas=1447, total_alunos=4221),
    "classes_by_state_total": dict(total_turmas=1447),
    "state_filtered_kpis": dict(total_professores=56, total_turmas=107, total_alunos=301),
    "class_kpis": dict(total_professores=97, total_turmas=1308, total_alunos=3927),
    "improvement_kpis": dict(total_professores=94, total_turmas=414, soma_alunos=1878, alunos_evid=544, total_professores_50=62),
    "improvement_kpis_assessed": dict(total_professores=94, total_turmas=414, soma_alunos=1695, alunos_evid=544, total_professores_50=72),
    "student_class_kpis": dict(total_alunos=4068, total_turmas=1355, total_escolas=25),
    "overall_improvement_rate": dict(total_alunos=1608, total_melhorias=626, percentual_total_melhoria=626 / 1608 * 100),
}
# The report queries; those of optional parts of the registry have tests of their own.
NAMES = sorted(registry.oracle_queries())


@pytest.fixture(scope="module")
def connection():
    return duck(TESTDATA)


def test_every_query_has_a_twin():
    assert set(NAMES) <= set(registry.queries()) and set(NAMES) <= set(registry.oracle_sql())
    assert set(registry.oracle_sql()) <= set(registry.queries())


RANKED = {
    "state_order", "state_choices", "teachers_by_state", "classes_by_state", "teachers_by_state_filtered",
    "classes_by_state_filtered",
}


def check_plan(plan: str, name: str) -> None:
    """No cross products, no Python in the plan, and no window over all detail rows."""
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan
    lines = plan.splitlines()
    unpartitioned = [
        line for i, line in enumerate(lines)
        if re.search(r"\bWindow \[", line) and any("SinglePartition" in below for below in lines[i + 1:i + 4])
    ]
    # Only the few categories of a ranking are ever numbered together.
    assert len(unpartitioned) == (name in RANKED)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    df = registry.queries()[name](spark, TESTDATA)
    check_plan(df._jdf.queryExecution().executedPlan().toString(), name)
    sql = registry.oracle_sql()[name]
    assert sorted(df.columns) == sorted(c[0] for c in connection.execute(sql).description)
    rows = spark_rows(df)
    assert rows == duck_rows(connection, sql)
    if TESTDATA.endswith("sf0.001"):
        if name in ROWS:
            assert len(rows) == ROWS[name]
        if name in VALUES:
            assert rows == [tuple(VALUES[name][c] for c in sorted(df.columns))]


def test_entry(spark):
    assert registry.entry(spark).count() == 534
