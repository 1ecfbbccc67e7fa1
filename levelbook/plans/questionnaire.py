"""What teachers answered, and whether they answered everything."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.functions.vocabulary import ANSWERED_ALL, ANSWERED_PARTLY, CHALLENGE_LABELS, ONBOARDING_TYPE
from levelbook.operators.accounts import exclude_accounts
from levelbook.operators.counts import distinct_kpis, recode, rows_per, series_for
from levelbook.plans.logins import Accounts
from levelbook.sources import TableSet


def questionnaire_answers(
    tables: TableSet,
    excluded: Accounts,
    type_name: str = ONBOARDING_TYPE,
    min_answers: int = 3,
    ordered: bool = False,
) -> DataFrame:
    """Every answer to questionnaires of one type, with its teacher's answered-all status.

    The status counts a teacher's answers to questionnaires of *all* types. It is counted
    per response, then per teacher, both combined before the shuffle, and becomes part of
    the teacher row; answers meet it through their response, and are shuffled once.
    """
    question = tables.table("questionnaire_question").select(F.col("id").alias("question_id"), "label")
    kind = tables.table("questionnaire_type").select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    questionnaire = (
        tables.table("questionnaire").join(kind, "type_id").select(F.col("id").alias("questionnaire_id"), "type_name")
    )
    answers = tables.table("questionnaire_answer").join(question, "question_id")
    responses = tables.table("questionnaire_response").withColumnRenamed("id", "response_id").join(
        questionnaire, "questionnaire_id"
    )

    per_response = answers.groupBy("response_id").agg(F.count("id").alias("n"))
    per_teacher = per_response.join(responses, "response_id").groupBy("teacher_id").agg(F.sum("n").alias("n"))
    teacher = (
        exclude_accounts(tables.table("teacher"), excluded)
        .select(F.col("id").alias("teacher_id"), "auth_id")
        .join(per_teacher, "teacher_id")
    )
    asked = responses.filter(F.col("type_name") == type_name).join(teacher, "teacher_id")
    status = F.when(F.col("n") >= min_answers, ANSWERED_ALL).otherwise(ANSWERED_PARTLY)
    rows = answers.select("response_id", "label", "value").join(asked, "response_id").select(
        F.col("teacher_id").alias("id_professor"),
        F.col("auth_id").alias("id_nova_escola"),
        F.col("label").alias("pergunta"),
        F.col("value").alias("resposta"),
        F.col("created_at").alias("data_resposta"),
        status.alias("status_resposta"),
    )
    return rows.orderBy("id_professor", "data_resposta") if ordered else rows


def answered_all(rows: DataFrame) -> DataFrame:
    return series_for(rows, "status_resposta", ANSWERED_ALL)


def answered_partly(rows: DataFrame) -> DataFrame:
    return series_for(rows, "status_resposta", ANSWERED_PARTLY)


def questionnaire_kpis(rows: DataFrame) -> DataFrame:
    status = F.col("status_resposta")
    return distinct_kpis(rows, {
        "total_professores": ("id_professor", status == ANSWERED_ALL),
        "total_professores_n": ("id_professor", status == ANSWERED_PARTLY),
    })


def answer_summary(rows: DataFrame) -> DataFrame:
    """Answers per status, question and answer."""
    return rows_per(rows, ["status_resposta", "pergunta", "resposta"])


def answer_summary_recoded(rows: DataFrame, labels: Mapping[str, str] = CHALLENGE_LABELS) -> DataFrame:
    """The summary with a display label per answer."""
    return recode(answer_summary(rows), "resposta", labels, into="resposta_ajustada")


def question_series(summary: DataFrame, question: str) -> DataFrame:
    """The rows of the summary for one question."""
    return series_for(summary, "pergunta", question)
