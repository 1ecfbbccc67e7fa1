"""How the levels of students change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.operators.counts import groups_with_more_than
from levelbook.operators.skew import HOT_ROWS, HotChunks, row_numbered
from levelbook.plans.roster import classes_with_school
from levelbook.sources import TableSet


def _with_level(tables: TableSet) -> DataFrame:
    level = tables.table("diagnostic_assessment_type_hypothesis").select(
        F.col("id").alias("hypothesis_id"), "ordering", F.col("name").alias("nome_hipotese")
    )
    return tables.table("diagnostic_assessment_students").join(level, "hypothesis_id")


def student_levels(tables: TableSet) -> DataFrame:
    """Per student: lowest and highest level, first and last name by text, first and last date."""
    return _with_level(tables).groupBy("student_id").agg(
        F.min("ordering").alias("ordem_inicial"),
        F.max("ordering").alias("ordem_final"),
        F.min("nome_hipotese").alias("estado_inicial"),
        F.max("nome_hipotese").alias("estado_final"),
        F.min("created_at").alias("data_inicial"),
        F.max("created_at").alias("data_final"),
    )


def changed_students(tables: TableSet) -> DataFrame:
    """The rows of :func:`student_levels` with more than one level, up or down."""
    return student_levels(tables).filter(F.col("ordem_inicial") != F.col("ordem_final"))


def student_evolution(tables: TableSet, ordered: bool = False) -> DataFrame:
    """The students whose level changed. Grouped before the join, so the join has one row per student."""
    student = tables.table("student").select(F.col("id").alias("id_aluno"), F.col("name").alias("nome_aluno"))
    rows = changed_students(tables).join(student, F.col("student_id") == F.col("id_aluno")).select(
        "id_aluno", "nome_aluno", "ordem_inicial", "ordem_final",
        "estado_inicial", "estado_final", "data_inicial", "data_final",
    )
    return rows.orderBy("nome_aluno") if ordered else rows


def evolved_students_count(tables: TableSet) -> DataFrame:
    """Students with more than one level on more than one date; known students or not.

    More than one distinct date is the same as a first date before the last one, which
    needs no distinct aggregate.
    """
    dated = changed_students(tables).filter(F.col("data_inicial") < F.col("data_final"))
    return dated.agg(F.count(F.lit(1)).alias("total_students_with_evolution"))


def evolved_students_distinct(tables: TableSet) -> DataFrame:
    """One row with a 1 per known student whose level changed."""
    known = tables.table("student").select(F.col("id").alias("student_id"))
    return changed_students(tables).join(known, "student_id", "left_semi").select(
        F.lit(1).cast("long").alias("total_alunos_distintos_com_evolucao")
    )


def evolved_students_n(tables: TableSet) -> DataFrame:
    return evolved_students_distinct(tables).agg(F.count(F.lit(1)).alias("total_students_with_evolution"))


def teachers_multi_class(tables: TableSet) -> DataFrame:
    """One row with a 1 per known teacher with more than one class."""
    teaching = groups_with_more_than(tables.table("class"), ["teacher_id"], "id", 1)
    known = tables.table("teacher").select(F.col("id").alias("teacher_id"))
    return teaching.join(known, "teacher_id", "left_semi").select(
        F.lit(1).cast("long").alias("total_teachers_with_multiple_classes")
    )


def teachers_multi_class_n(tables: TableSet) -> DataFrame:
    return teachers_multi_class(tables).agg(F.count(F.lit(1)).alias("total_profs_mais"))


def classes_multi_assessment(tables: TableSet) -> DataFrame:
    """One row per class with more than one assessment: 1, or 0 for assessments without a class."""
    assessed = groups_with_more_than(tables.table("diagnostic_assessment"), ["class_id"], "id", 1)
    return assessed.select(
        F.col("class_id").isNotNull().cast("long").alias("total_classes_with_multiple_assessments")
    )


def classes_multi_assessment_n(tables: TableSet) -> DataFrame:
    """Those classes as a sum, and as a number of rows."""
    ones = F.col("total_classes_with_multiple_assessments")
    return classes_multi_assessment(tables).agg(
        F.coalesce(F.sum(ones), F.lit(0)).alias("total_turmas"), F.count(F.lit(1)).alias("total_turmas_mais")
    )


def hypothesis_history(tables: TableSet, ordered: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every level a student got, numbered by assessment date (then assessment, then level).

    Numbered before the student, class and school are joined: those keep or drop a student
    as a whole, so the numbers are the same. The rows of a student
    with more than ``hot_rows`` of them are cut by the quantiles of all assessments' dates.
    """
    assessment = tables.table("diagnostic_assessment").select(
        F.col("id").alias("diagnostic_assessment_id"), F.col("created_at").alias("assessed_at")
    )
    levels = (
        _with_level(tables)
        .select("student_id", "diagnostic_assessment_id", "hypothesis_id", "nome_hipotese")
        .join(assessment, "diagnostic_assessment_id")
        .filter(F.col("student_id").isNotNull())
    )
    numbered = row_numbered(
        levels,
        ["student_id"],
        ["assessed_at", "diagnostic_assessment_id", "hypothesis_id"],
        chunk=HotChunks(
            tables.table("diagnostic_assessment_students").select("student_id"), assessment.select("assessed_at"), hot_rows
        ),
    )
    student = tables.table("student").select(
        F.col("id").alias("student_id"), F.col("name").alias("nome_aluno"), F.col("class_id").alias("id_turma")
    )
    placed = student.join(classes_with_school(tables), "id_turma")
    rows = numbered.join(placed, "student_id").select(
        "student_id", "nome_aluno", "nome_turma", "ano_turma", "cod_inep",
        "nome_escola", "cidade_escola", "estado_escola", "nome_hipotese",
        F.col("assessed_at").alias("created_at"), "rn",
    )
    return rows.orderBy("student_id", "rn") if ordered else rows
