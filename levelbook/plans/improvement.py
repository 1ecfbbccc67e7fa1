"""Which share of a class improved, in total, per month and per state."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levelbook.functions.columns import month_name, month_number_from_text, percentage, share
from levelbook.operators.accounts import exclude_accounts
from levelbook.operators.counts import distinct_per, mean_per, rows_per, top_k
from levelbook.plans.logins import Accounts
from levelbook.plans.roster import classes, classes_with_school
from levelbook.sources import TableSet


def level_state(tables: TableSet, rows: DataFrame | None = None, by_month: bool = True) -> DataFrame:
    """Per student: lowest and highest level; by month also the month of the latest assessment and
    its moment. ``rows`` stand for all of ``diagnostic_assessment_students``."""
    rows = tables.table("diagnostic_assessment_students") if rows is None else rows
    level = tables.table("diagnostic_assessment_type_hypothesis").select(
        F.col("id").alias("hypothesis_id"), "ordering"
    )
    rows = rows.select("student_id", "diagnostic_assessment_id", "hypothesis_id").join(level, "hypothesis_id")
    bounds = [F.min("ordering").alias("lowest"), F.max("ordering").alias("highest")]
    if not by_month:
        return rows.groupBy("student_id").agg(*bounds)
    # A level without a known assessment counts for the bounds in total, not by month.
    assessment = tables.table("diagnostic_assessment").select(
        F.col("id").alias("diagnostic_assessment_id"),
        F.struct("created_at", "id").alias("moment"),
        month_number_from_text(F.col("month")).alias("month"),
    )
    return rows.join(assessment, "diagnostic_assessment_id").groupBy("student_id").agg(
        *bounds, F.max_by("month", "moment").alias("month"), F.max("moment").alias("moment")
    )


def merged_levels(states: DataFrame) -> DataFrame:
    """Several states of students, such as a stored one and that of new rows, as one."""
    bounds = [F.min("lowest").alias("lowest"), F.max("highest").alias("highest")]
    latest = [F.max_by("month", "moment").alias("month"), F.max("moment").alias("moment")]
    return states.groupBy("student_id").agg(*bounds, *(latest if "moment" in states.columns else []))


def class_improvement(
    tables: TableSet,
    by_month: bool = False,
    denominator: Literal["all", "assessed"] = "all",
    excluded: Accounts | None = None,
    levels: DataFrame | None = None,
    classes_of: DataFrame | None = None,
) -> DataFrame:
    """Classes in which some student's lowest and highest level differ, and how many do.

    In total: one row per class with a known teacher. By month: one row per class and
    month of the improved students' latest assessment, for classes with a school whose
    teacher is not excluded. The denominator is all students of the class, or those that
    ever stood above the first level.

    Everything is one pass over the students: each student meets at most one row of
    levels, and a class (by month) is summed up before it is shuffled. Class, teacher and
    school join afterwards, at one row per class and month, so a huge class is an ordinary row by then.

    ``levels`` are stored ones of :func:`level_state`; ``classes_of`` (a column ``id_turma``) restricts
    the report to some classes.
    """
    levels = level_state(tables, by_month=by_month) if levels is None else levels
    students = tables.table("student").select(F.col("id").alias("student_id"), F.col("class_id").alias("id_turma"))
    if classes_of is not None:
        students = students.join(classes_of, "id_turma", "left_semi")
    counted = F.lit(True) if denominator == "all" else F.col("highest") > 1
    per_class = (
        students.join(levels, "student_id", "left")
        .groupBy("id_turma", *(["month"] if by_month else []))
        .agg(
            F.count_if(counted).alias("total_alunos"),
            F.count_if(F.col("lowest") < F.col("highest")).alias("alunos_com_melhoria"),
        )
    )
    improved = (F.col("alunos_com_melhoria") > 0) & (F.col("total_alunos") > 0)
    rate = percentage(F.col("alunos_com_melhoria"), F.col("total_alunos")).alias("porcentagem_melhoria")
    teacher = tables.table("teacher")
    known = (teacher if excluded is None else exclude_accounts(teacher, excluded)).select(
        F.col("id").alias("id_professor")
    )
    if not by_month:
        rows = (
            per_class.filter(improved)
            .join(classes(tables), "id_turma")
            .join(known, F.col("_teacher") == F.col("id_professor"), "left_semi")
        )
        return rows.select(
            F.col("id_turma").alias("turma_id"), "nome_turma", F.col("_teacher").alias("professor_id"),
            "total_alunos", "alunos_com_melhoria", rate,
        )
    # The months of one class, a handful of rows, add up to its students.
    whole_class = F.sum("total_alunos").over(Window.partitionBy("id_turma"))
    rows = (
        per_class.withColumn("total_alunos", whole_class)
        .filter(improved)
        .join(classes_with_school(tables), "id_turma")
        .join(known, F.col("_teacher") == F.col("id_professor"), "left_semi")
    )
    return rows.select(
        "id_turma", F.col("cod_inep").alias("cod_inep_turma"), "nome_turma", "ano_turma",
        "nome_escola", "cidade_escola", "estado_escola", F.col("_teacher").alias("id_professor"),
        "total_alunos", "alunos_com_melhoria", rate, month_name(F.col("month")).alias("mes_sondagem"),
    )


def improvement_kpis(rows: DataFrame, at_least: float = 50) -> DataFrame:
    """Key figures of the improvement by month.

    ``soma_alunos`` counts a class once per month row. ``total_professores_50`` counts
    teachers with a row of ``at_least`` percent.
    """
    # A class has one teacher: one row per class, then one per teacher, then one.
    per_class = rows.groupBy("id_professor", "id_turma").agg(
        F.sum("total_alunos").alias("soma"),
        F.sum("alunos_com_melhoria").alias("evid"),
        F.coalesce(F.bool_or(F.col("porcentagem_melhoria") >= at_least), F.lit(False)).alias("enough"),
    )
    per_teacher = per_class.groupBy("id_professor").agg(
        F.count("id_turma").alias("turmas"), F.sum("soma").alias("soma"), F.sum("evid").alias("evid"),
        F.bool_or("enough").alias("enough"),
    )
    return per_teacher.agg(
        F.count("id_professor").alias("total_professores"),
        F.coalesce(F.sum("turmas"), F.lit(0)).alias("total_turmas"),
        F.coalesce(F.sum("soma"), F.lit(0)).alias("soma_alunos"),
        F.coalesce(F.sum("evid"), F.lit(0)).alias("alunos_evid"),
        F.count_if(F.col("enough") & F.col("id_professor").isNotNull()).alias("total_professores_50"),
    )


def rows_by_month(rows: DataFrame, ordered: bool = False) -> DataFrame:
    result = rows_per(rows, ["mes_sondagem"], "total_sondagens")
    return result.orderBy("mes_sondagem") if ordered else result


def teachers_by_month(rows: DataFrame, ordered: bool = False) -> DataFrame:
    result = distinct_per(rows, "mes_sondagem", "id_professor", "total_professores")
    return result.orderBy("mes_sondagem") if ordered else result


def classes_by_month(rows: DataFrame, ordered: bool = False) -> DataFrame:
    result = distinct_per(rows, "mes_sondagem", "id_turma", "total_turmas")
    return result.orderBy("mes_sondagem") if ordered else result


def improved_classes_by_state(rows: DataFrame) -> DataFrame:
    return distinct_per(rows, "estado_escola", "id_turma", "total_turmas")


def mean_improvement_by_month(rows: DataFrame) -> DataFrame:
    return mean_per(rows, "mes_sondagem", "porcentagem_melhoria")


def mean_improvement_by_state(rows: DataFrame) -> DataFrame:
    return mean_per(rows, "estado_escola", "porcentagem_melhoria")


def top_states(by_state: DataFrame, k: int = 5) -> DataFrame:
    return top_k(by_state, "porcentagem_melhoria", k, "estado_escola")


def overall_improvement_rate(rows: DataFrame) -> DataFrame:
    """Improved students as a share of all students of the classes with improvement."""
    sums = rows.filter(F.col("alunos_com_melhoria") > 0).agg(
        F.coalesce(F.sum("total_alunos"), F.lit(0)).alias("total_alunos"),
        F.coalesce(F.sum("alunos_com_melhoria"), F.lit(0)).alias("total_melhorias"),
    )
    rate = share(F.col("total_melhorias"), F.col("total_alunos"))
    return sums.withColumn("percentual_total_melhoria", rate)
