"""Schemas of the twelve input tables.

``KEYS`` is a contract with the data, as the primary keys of an operational database
are: at most one row per key. The plans use it to count ids without a shuffle, and to join a
table by its key without grouping the (much larger) join result again.
:func:`levelbook.sources.keys.check_keys` counts violations.
"""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

_TYPES = {"id": LongType(), "int": IntegerType(), "text": StringType(), "time": TimestampNTZType()}


def _schema(**columns: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


SCHEMAS: dict[str, StructType] = {
    "teacher": _schema(
        id="id", auth_id="text", confirmed="int", active="int",
        onboarding_completed="int", created_at="time", updated_at="time",
    ),
    "class": _schema(
        id="id", teacher_id="id", name="text", year="int", cod_inep="int", created_at="time",
    ),
    "student": _schema(id="id", class_id="id", name="text", active="int", created_at="time"),
    "school": _schema(cod_inep="int", name="text", municipio="text", uf="text"),
    "diagnostic_assessment": _schema(
        id="id", teacher_id="id", class_id="id", month="text", created_at="time",
    ),
    "diagnostic_assessment_students": _schema(
        student_id="id", diagnostic_assessment_id="id", hypothesis_id="int",
        comment="text", created_at="time",
    ),
    "diagnostic_assessment_type_hypothesis": _schema(id="int", name="text", ordering="int"),
    "questionnaire_type": _schema(id="int", name="text"),
    "questionnaire": _schema(id="int", type_id="int"),
    "questionnaire_question": _schema(id="int", label="text"),
    "questionnaire_response": _schema(
        id="id", teacher_id="id", questionnaire_id="int", created_at="time",
    ),
    "questionnaire_answer": _schema(id="id", response_id="id", question_id="int", value="text"),
}

KEYS: dict[str, str] = {
    "teacher": "id",
    "class": "id",
    "student": "id",
    "school": "cod_inep",
    "diagnostic_assessment": "id",
    "diagnostic_assessment_type_hypothesis": "id",
    "questionnaire_type": "id",
    "questionnaire": "id",
    "questionnaire_question": "id",
    "questionnaire_response": "id",
    "questionnaire_answer": "id",
}

# Tables that only name things: levels, and the parts of a questionnaire.
LOOKUPS = (
    "diagnostic_assessment_type_hypothesis",
    "questionnaire_type",
    "questionnaire",
    "questionnaire_question",
)
