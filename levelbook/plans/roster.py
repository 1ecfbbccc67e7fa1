"""Teachers with their classes and students, and the figures per day and per state."""

from __future__ import annotations

from collections.abc import Callable, Collection
from math import ceil
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.functions.columns import share
from levelbook.functions.vocabulary import ALL_STATES, HAS_CLASS, NO_CLASS, ONBOARDING_DONE, ONBOARDING_OPEN, UNKNOWN_STATE
from levelbook.operators.accounts import exclude_accounts
from levelbook.operators.counts import distinct_kpis, distinct_per, first_appearance_rank, nested_kpis, per_day, spread_minutes
from levelbook.operators.filters import state_filter
from levelbook.operators.parts import JoinParts
from levelbook.operators.skew import HOT_PAIRS, fan_out_join
from levelbook.plans.logins import Accounts
from levelbook.sources import TableSet
from levelbook.sources.staging import staged_path

ROSTER_KEYS = ("id_professor", "id_turma", "id_aluno")
# So many levels, with their students and assessments, are paired at a time where the pairing is stored.
PART_LEVELS = 1 << 24


def schools(tables: TableSet) -> DataFrame:
    return tables.table("school").select(
        F.col("cod_inep").alias("_inep"),
        F.col("name").alias("nome_escola"),
        F.col("municipio").alias("cidade_escola"),
        F.col("uf").alias("estado_escola"),
    )


def classes(tables: TableSet) -> DataFrame:
    return tables.table("class").select(
        F.col("id").alias("id_turma"),
        F.col("teacher_id").alias("_teacher"),
        F.col("name").alias("nome_turma"),
        F.col("year").alias("ano_turma"),
        F.col("cod_inep"),
        F.col("created_at").alias("data_cadastro_turma"),
    )


def classes_with_school(tables: TableSet, how: str = "inner") -> DataFrame:
    school = schools(tables)
    return classes(tables).join(school, F.col("cod_inep") == F.col("_inep"), how).drop("_inep")


def teacher_class_student(
    tables: TableSet,
    excluded: Accounts,
    how: Literal["left", "inner"] = "left",
    ordered: bool = False,
) -> DataFrame:
    """One row per teacher, class and student, with the class's school.

    ``how="inner"`` gives registered classes only: a teacher, a student and a school each.
    ``how="left"`` also gives teachers without a class, classes without a student and
    classes without a school, and adds two flags.

    The outer chain is built as matched rows plus the unmatched ones. Written as left
    joins, the big side (classes of a teacher, students of a class) would sit on the side
    of the join that must not be split, and one teacher or class with very many rows would
    keep one task busy. As an inner join that side can be split. The unmatched rows need
    only the keys of the big side, combined before they are shuffled.
    """
    teacher = exclude_accounts(tables.table("teacher"), excluded).select(
        F.col("id").alias("id_professor"),
        F.col("auth_id").alias("id_nova_escola"),
        F.col("created_at").alias("data_cadastro_professor"),
        F.when(F.col("onboarding_completed") == 1, ONBOARDING_DONE).otherwise(ONBOARDING_OPEN).alias("flag_onboarding"),
    )
    student = tables.table("student").select(
        F.col("class_id").alias("_class"),
        F.col("id").alias("id_aluno"),
        F.col("name").alias("nome_aluno"),
        F.col("created_at").alias("data_cadastro_aluno"),
    )
    taught = classes_with_school(tables, how).join(teacher, F.col("_teacher") == F.col("id_professor"))
    rows = taught.join(student, F.col("id_turma") == F.col("_class"))
    if how == "left":
        filled = student.select("_class").distinct()
        teaching = tables.table("class").select(F.col("teacher_id").alias("_teacher")).distinct()
        empty = taught.join(filled, F.col("id_turma") == F.col("_class"), "left_anti")
        idle = teacher.join(teaching, F.col("id_professor") == F.col("_teacher"), "left_anti")
        rows = rows.unionByName(empty, allowMissingColumns=True).unionByName(idle, allowMissingColumns=True)

    flag_class = F.when(F.col("id_turma").isNotNull(), HAS_CLASS).otherwise(NO_CLASS).alias("flag_turma")
    result = rows.select(
        "id_professor", "id_nova_escola", "data_cadastro_professor",
        *(["flag_onboarding", flag_class] if how == "left" else []),
        "id_turma", "nome_turma", "ano_turma", "data_cadastro_turma",
        "id_aluno", "nome_aluno",
        "nome_escola", "cidade_escola", "estado_escola",
        "data_cadastro_aluno",
    )
    return result.orderBy(*ROSTER_KEYS) if ordered else result


def _assessments(tables: TableSet) -> DataFrame:
    """Assessments given by a known teacher."""
    known = tables.table("teacher").select(F.col("id").alias("teacher_id"))
    return tables.table("diagnostic_assessment").join(known, "teacher_id", "left_semi")


def students_by_class(
    tables: TableSet,
    ordered: bool = False,
    pairs_per_task: int = HOT_PAIRS,
    store: Callable[[JoinParts], DataFrame] | None = None,
    part_levels: int = PART_LEVELS,
) -> DataFrame:
    """Every assessment of a class paired with every level of every student of that class.

    Levels pair by student, not by assessment. So the comments shrink to one per student and level
    *before* the join that multiplies rows; with one row per key in the other tables, each
    joined row is then already one group, and nothing is grouped after the join.
    The pairing itself is many-to-many on the class, hence :func:`fan_out_join`.

    ``store`` writes the report, which is then computed once, right away, in parts of about ``part_levels`` levels
    (see :class:`JoinParts`), and gives the stored rows, which are returned. That is for tables whose shuffle files
    are too much for the disk, and for readers that go over the report more than once.
    """
    level = tables.table("diagnostic_assessment_type_hypothesis").select(
        F.col("id").alias("hipotese"), F.col("name").alias("nome_hipotese")
    )
    comments = (
        tables.table("diagnostic_assessment_students")
        .groupBy("student_id", F.col("hypothesis_id").alias("hipotese"))
        .agg(F.max("comment").alias("comentario"))
    )
    student = tables.table("student").select(
        F.col("id").alias("id_aluno"), F.col("name").alias("nome_aluno"), F.col("class_id").alias("id_turma")
    )
    students = (
        comments.join(student, F.col("student_id") == F.col("id_aluno"))
        .drop("student_id")
        .join(level, "hipotese")
    )
    assessments = _assessments(tables).select(
        F.col("teacher_id").alias("id_professor"),
        F.col("class_id").alias("id_turma"),
        F.col("id").alias("id_avaliacao"),
        F.col("month").alias("mes_avaliacao"),
        F.col("created_at").alias("data_criacao_avaliacao"),
    )
    # The report groups by its school columns, so a school that is stored twice still gives one row.
    in_school = (
        classes(tables).join(schools(tables).distinct(), F.col("cod_inep") == F.col("_inep"))
        .select("id_turma", "nome_turma", "ano_turma", "cod_inep", "nome_escola", "cidade_escola", "estado_escola")
    )
    in_class = assessments.join(in_school, "id_turma")

    def paired(
        left: DataFrame, right: DataFrame, left_rows: DataFrame | None = None, right_rows: DataFrame | None = None
    ) -> DataFrame:
        return fan_out_join(left, right, "id_turma", left_rows, right_rows, pairs_per_task).select(
            "id_professor", "id_turma", "nome_turma", "ano_turma", "id_aluno", "nome_aluno",
            "cod_inep", "nome_escola", "cidade_escola", "estado_escola",
            "id_avaliacao", "mes_avaliacao", "hipotese", "nome_hipotese",
            "comentario", "data_criacao_avaliacao",
        )

    if store is None:
        rows = paired(
            in_class,
            students,
            left_rows=tables.table("diagnostic_assessment").select(F.col("class_id").alias("id_turma")),
            right_rows=tables.table("student").select(F.col("class_id").alias("id_turma")),
        )
    else:
        parts = max(1, ceil(tables.table("diagnostic_assessment_students").count() / part_levels))
        path = staged_path(students.sparkSession, "pairing-sides")
        rows = store(JoinParts(in_class, students, "id_turma", paired, parts, path))
    return rows.orderBy(F.col("data_criacao_avaliacao").desc()) if ordered else rows


def assessed_students(tables: TableSet) -> DataFrame:
    """The students that occur in :func:`students_by_class`, once each, without its pairs.

    ``hipotese`` is the student's level with the largest id among those with a name.
    """
    level = tables.table("diagnostic_assessment_type_hypothesis").select(F.col("id").alias("hypothesis_id"), "name")
    named = F.when(F.col("name").isNotNull(), F.col("hypothesis_id"))
    levels = (
        tables.table("diagnostic_assessment_students")
        .join(level, "hypothesis_id")
        .groupBy("student_id")
        .agg(F.max(named).alias("hipotese"))
    )
    assessed = _assessments(tables).select(F.col("class_id").alias("id_turma")).distinct()
    known = tables.table("school").select(F.col("cod_inep").alias("_inep"))
    in_school = (
        classes(tables).select("id_turma", "cod_inep")
        .join(known, F.col("cod_inep") == F.col("_inep"), "left_semi")
        .join(assessed, "id_turma", "left_semi")
    )
    student = tables.table("student").select(F.col("id").alias("id_aluno"), F.col("class_id").alias("id_turma"))
    return levels.join(student.join(in_school, "id_turma"), F.col("student_id") == F.col("id_aluno")).select(
        "id_aluno", "id_turma", "cod_inep", "hipotese"
    )


def student_class_kpis(rows: DataFrame) -> DataFrame:
    """Distinct students, classes and schools of :func:`students_by_class` rows.

    :func:`assessed_students` gives the same figures from far fewer rows.
    """
    kpis = nested_kpis(rows, {"total_escolas": "cod_inep", "total_turmas": "id_turma", "total_alunos": "id_aluno"})
    return kpis.select("total_alunos", "total_turmas", "total_escolas")


def first_hypothesis_counts(tables: TableSet) -> DataFrame:
    """How many students have each level first, with their newest assessment on top.

    A student's levels pair with all assessments of the class alike, so the order by
    assessment leaves a tie between them; the larger level id wins it. Names are looked up
    for the counts, not for the students.
    """
    level = tables.table("diagnostic_assessment_type_hypothesis").select(
        F.col("id").alias("hipotese"), F.col("name").alias("nome_hipotese")
    )
    first = assessed_students(tables).groupBy("hipotese").agg(F.count(F.lit(1)).alias("count"))
    return first.join(level, "hipotese").groupBy("nome_hipotese").agg(F.sum("count").alias("count"))


# Figures on the rows of teacher_class_student.

_TEACHING = {"total_professores": "id_professor", "total_turmas": "id_turma", "total_alunos": "id_aluno"}


def teacher_kpis(rows: DataFrame) -> DataFrame:
    """Distinct teachers, classes and students; the id 0 stands for a filled NULL."""
    return nested_kpis(rows, _TEACHING, {name: F.col(column) != 0 for name, column in _TEACHING.items()})


def class_kpis(rows: DataFrame) -> DataFrame:
    return nested_kpis(rows, _TEACHING)


def teachers_per_day(rows: DataFrame, name: str = "total_professores") -> DataFrame:
    return per_day(rows, "data_cadastro_professor", "id_professor", name)


def registration_spread(rows: DataFrame) -> DataFrame:
    return spread_minutes(rows, "data_cadastro_professor", "tempo_medio_cadastro")


def state_order(rows: DataFrame) -> DataFrame:
    """States numbered from 0 as they first appear by teacher, class and student."""
    return first_appearance_rank(rows, "estado_escola", ROSTER_KEYS).filter(F.col("estado_escola").isNotNull())


def state_choices(rows: DataFrame) -> DataFrame:
    """What a choice of states offers: the all-token, then the states by first appearance, then the
    missing one as NULL if there is one."""
    ranked = first_appearance_rank(rows, "estado_escola", ROSTER_KEYS).withColumn("ordem", F.col("ordem") + 1)
    every = rows.sparkSession.range(1).select(F.lit(ALL_STATES).alias("estado_escola"), F.lit(0).alias("ordem"))
    return every.unionByName(ranked)


def _state_rank(all_rows: DataFrame | None) -> DataFrame | tuple[str, ...]:
    return ROSTER_KEYS if all_rows is None else first_appearance_rank(all_rows, "estado_escola", ROSTER_KEYS)


def teachers_by_state(
    rows: DataFrame, all_rows: DataFrame | None = None, states: Collection[str | None] | None = None
) -> DataFrame:
    """Distinct teachers per state, ranked by first appearance.

    A choice of ``states`` picks from the counts of all rows, which already hold the ranks. Give ``all_rows``, the rows
    of all states, when ``rows`` are a selection by something else.
    """
    counted = distinct_per(rows, "estado_escola", "id_professor", "total_professores", order=_state_rank(all_rows))
    return counted if states is None else state_filter(counted, states)


def classes_by_state(
    rows: DataFrame, all_rows: DataFrame | None = None, states: Collection[str | None] | None = None
) -> DataFrame:
    """Distinct classes per state, those without a state under their own label, last. ``states`` and
    ``all_rows`` as in :func:`teachers_by_state`; None among the states stands for those without one."""
    counted = distinct_per(
        rows, "estado_escola", "id_turma", "total_turmas", keep_null=UNKNOWN_STATE, order=_state_rank(all_rows)
    )
    return counted if states is None else state_filter(counted, [UNKNOWN_STATE if s is None else s for s in states])


def classes_by_state_total(by_state: DataFrame) -> DataFrame:
    return by_state.agg(F.sum("total_turmas").alias("total_turmas"))


def onboarding_rate(rows: DataFrame) -> DataFrame:
    """Teachers, those with a finished onboarding, their share in percent, and the rest."""
    done = F.col("flag_onboarding") == ONBOARDING_DONE
    counted = distinct_kpis(rows, {
        "total_professores": "id_professor",
        "professores_onboarding_completo": ("id_professor", done),
    })
    total, complete = F.col("total_professores"), F.col("professores_onboarding_completo")
    return counted.select(
        total,
        complete,
        share(complete, total).alias("taxa_onboarding_completo"),
        F.greatest(total - complete, F.lit(0)).alias("professores_onboarding_incompleto"),
    )
