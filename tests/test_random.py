"""Random small tables with gaps, orphans and ties: every report against its DuckDB twin."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from conftest import SMALL_SKEW, duck, duck_rows, spark_rows
from pyspark.sql.pandas.types import to_arrow_schema

from levelbook.checks.oracle import REPORTS, on
from levelbook.checks.sample import EXCLUDED
from levelbook.plans import improvement, levels, logins, questionnaire, roster
from levelbook.sources import SCHEMAS

PLANS = {
    "logins": lambda t: logins.logins(t, EXCLUDED),
    "students_by_class": roster.students_by_class,
    "student_evolution": levels.student_evolution,
    "hypothesis_history": levels.hypothesis_history,
    "class_improvement_total": improvement.class_improvement,
    "questionnaire_answers": lambda t: questionnaire.questionnaire_answers(t, EXCLUDED),
    "teacher_class_student": lambda t: roster.teacher_class_student(t, EXCLUDED),
    "registered_classes": lambda t: roster.teacher_class_student(t, EXCLUDED, how="inner"),
    "class_improvement_by_month": lambda t: improvement.class_improvement(t, by_month=True, excluded=EXCLUDED),
    "class_improvement_by_month_assessed": lambda t: improvement.class_improvement(
        t, by_month=True, denominator="assessed", excluded=EXCLUDED),
}


def random_rows(seed: int) -> dict[str, list[dict]]:
    """Small key ranges, so that orphans, repeats and ties are common; the first key is hot."""
    r = random.Random(seed)

    def some(n: int, gap: float = 0.1):
        if r.random() < gap:
            return None
        return 1 if r.random() < 0.3 else r.randint(1, n)

    def moment():
        return None if r.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=12 * r.randint(0, 9), microseconds=r.randint(0, 1))

    def text(*values):
        return r.choice([*values, None])

    def keyed(n: int, limit: int) -> list[int]:
        return r.sample(range(1, limit + 1), n)

    return {
        "teacher": [dict(id=i, auth_id=text("3", "6", "7", "8", "9"), confirmed=r.randint(0, 1), active=r.randint(0, 1),
                         onboarding_completed=text(0, 1), created_at=moment(), updated_at=moment()) for i in keyed(8, 10)],
        "class": [dict(id=i, teacher_id=some(10), name=text("A", "B"), year=text(2023, 2024), cod_inep=some(5, 0.2),
                       created_at=moment()) for i in keyed(12, 14)],
        "student": [dict(id=i, class_id=some(14), name=text("x", "y"), active=text(0, 1), created_at=moment()) for i in keyed(30, 35)],
        # A school is known by its state in one twin, so states are always given.
        "school": [dict(cod_inep=i, name=text("E"), municipio=text("M", "N"), uf=r.choice(["SP", "AC"])) for i in keyed(4, 5)],
        "diagnostic_assessment": [dict(id=i, teacher_id=some(10), class_id=some(14), month=text("1", "02", "3", "12", "13", "x", "3a", ""),
                                       created_at=moment()) for i in keyed(20, 24)],
        "diagnostic_assessment_students": [dict(student_id=some(35), diagnostic_assessment_id=some(24), hypothesis_id=some(6),
                                                comment=text("c", "d"), created_at=moment()) for _ in range(120)],
        "diagnostic_assessment_type_hypothesis": [dict(id=i, name=text("p", "q", "r"), ordering=r.choice([0, 1, 2, 3])) for i in keyed(5, 6)],
        "questionnaire_type": [dict(id=1, name="Onboarding"), dict(id=2, name="Outro"), dict(id=3, name=None)],
        "questionnaire": [dict(id=i, type_id=some(4)) for i in keyed(5, 6)],
        "questionnaire_question": [dict(id=i, label=text("P", "Q")) for i in keyed(3, 4)],
        "questionnaire_response": [dict(id=i, teacher_id=some(10), questionnaire_id=some(6), created_at=moment()) for i in keyed(20, 25)],
        "questionnaire_answer": [dict(id=i, response_id=some(25), question_id=some(4), value=text("s", "n")) for i in keyed(50, 60)],
    }


@pytest.mark.parametrize("seed,settings", [(0, {}), (1, {}), (2, SMALL_SKEW)])
def test_reports_equal_sql(make_tables, conf, seed, settings):
    conf(**settings)
    rows = random_rows(seed)
    tables = make_tables(**rows)
    connection = duck()
    for name, schema in SCHEMAS.items():
        data = [{c: row.get(c) for c in schema.names} for row in rows[name]]
        connection.register(name, pa.Table.from_pylist(data, schema=to_arrow_schema(schema)))
    for name in REPORTS:
        expected = duck_rows(connection, on(name, "SELECT * FROM report", views=False))
        assert spark_rows(PLANS[name](tables)) == expected, name
