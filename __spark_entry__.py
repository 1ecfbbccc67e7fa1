"""The flagship query, every registered query, and its DuckDB twin.

All of them run on the whole test tables, read as the twelve tables of
``levelbook.sources`` through the views of ``levelbook.checks.sample``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelbook.checks.oracle import oracle_queries
from levelbook.checks.sample import EXCLUDED, sample_tables
from levelbook.functions.columns import month_number
from levelbook.operators.bitmaps import DAY, DailyCounts, day_bitmaps, rolled_up
from levelbook.operators.cleaning import fill_null_numeric, ids_as_text, infer_dates, normalize_ints, strip_tz
from levelbook.operators.filters import (
    CATEGORICAL,
    DATETIME,
    NUMERIC,
    TEXT,
    FilterSpec,
    apply_filters,
    filter_facets,
    profile_columns,
    state_filter,
)
from levelbook.operators.pages import SortedReport
from levelbook.operators.parts import JoinParts, store_parts
from levelbook.operators.profiles import ProfileStore
from levelbook.plans import improvement, levels, logins, questionnaire, roster, series
from levelbook.plans.refresh import ImprovementStore
from levelbook.sources import TableSet, check_keys
from levelbook.sources.staging import staged_path
from levelbook.sources.stored import store_tables, write_with_figures

try:  # the text operators are an optional part
    from levelbook.llm import queries as text_queries
except ImportError:
    text_queries = None
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

STATES = ["NATION_1", "NATION_2"]
ANSWER_LABELS = {"click": "cli<br>ck", "purchase": "pur<br>chase"}


def _logins(t: TableSet) -> DataFrame:
    return logins.logins(t, EXCLUDED)


def _roster(t: TableSet) -> DataFrame:
    return roster.teacher_class_student(t, EXCLUDED)


def _registered(t: TableSet) -> DataFrame:
    return roster.teacher_class_student(t, EXCLUDED, how="inner")


def _by_month(t: TableSet) -> DataFrame:
    return improvement.class_improvement(t, by_month=True, excluded=EXCLUDED)


def _by_month_assessed(t: TableSet) -> DataFrame:
    return improvement.class_improvement(t, by_month=True, denominator="assessed", excluded=EXCLUDED)


def _answers(t: TableSet) -> DataFrame:
    return questionnaire.questionnaire_answers(t, EXCLUDED)


def _mean_by_state(t: TableSet) -> DataFrame:
    return improvement.mean_improvement_by_state(_by_month(t))


def _profile_text(profile: DataFrame) -> DataFrame:
    return profile.withColumn("values", F.array_join("values", " | "))


def _merged_profile(t: TableSet) -> DataFrame:
    """The roster's profile from those of two loads: teachers registered before mid-January, and all others."""
    rows = _roster(t)
    store = ProfileStore(rows.sparkSession, staged_path(rows.sparkSession, "profiles"))
    early = F.coalesce(F.col("data_cadastro_professor") < F.lit(datetime(2024, 1, 15)), F.lit(False))
    store.add(rows.filter(early), "early")
    store.add(rows.filter(~early), "late")
    return _profile_text(store.profile().drop("n_estimated"))


def _month_starts(t: TableSet) -> DataFrame:
    """The improvement rows with their month as a text like 1996/03."""
    number = F.lpad(month_number(F.col("mes_sondagem")).cast("string"), 2, "0")
    return _by_month(t).select(
        "id_turma", "id_professor", "nome_turma", F.concat_ws("/", F.col("ano_turma").cast("string"), number).alias("mes")
    )


def _as_doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _integers(t: TableSet) -> DataFrame:
    totals = improvement.class_improvement(t).drop("nome_turma")
    return normalize_ints(_as_doubles(totals, "total_alunos", "alunos_com_melhoria"))


def _zoned(t: TableSet) -> DataFrame:
    return strip_tz(_logins(t).select("id_professor", F.col("data_criacao").cast("timestamp").alias("data_criacao")))


CHAIN = [
    FilterSpec("flag_turma", CATEGORICAL, values=["Tem Turma"]),
    FilterSpec("ano_turma", NUMERIC, lo=1995, hi=1997),
    FilterSpec("data_cadastro_professor", DATETIME, lo=date(2024, 1, 5), hi=date(2024, 1, 15)),
    FilterSpec("estado_escola", TEXT, pattern="^NATION_[1-9]$"),
]


# So many rows of the pairing are sorted at a time.
SORTED_PAIRS = 1 << 25


def _in_order(report: DataFrame | JoinParts, *order: str | Column, slice_rows: int | None = None) -> DataFrame:
    """The report with the place of every row in its display order."""
    return SortedReport.store(report, order, staged_path(report.sparkSession, "sorted"), slice_rows=slice_rows).rows()


def _stored(report: JoinParts) -> DataFrame:
    """The report in storage, for what reads it more than once."""
    return store_parts(report, staged_path(report.sparkSession, "report"))


def _teacher_days(t: TableSet, col: str = "id_professor", *keys: str) -> DataFrame:
    """The roster's daily bitmaps, stored day by day and read again."""
    rows = _roster(t)
    stored = DailyCounts(rows.sparkSession, staged_path(rows.sparkSession, "days"))
    stored.add(day_bitmaps(rows, "data_cadastro_professor", col, keys))
    return stored.read()


def _by_student(t: TableSet) -> TableSet:
    """The tables in a database of their own, levels and students bucketed by student."""
    spark = t.table("school").sparkSession
    database = f"levelbook_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{staged_path(spark, 'by-student')}'")
    return store_tables(t, spark, database, buckets=8)


def _refreshed(t: TableSet, **options) -> ImprovementStore:
    """The improvement as of mid-1996, brought up to date with the level rows since then."""
    rows = t.table("diagnostic_assessment_students")
    new = F.coalesce(F.col("created_at") >= F.lit(datetime(1996, 7, 1)), F.lit(False))
    before = TableSet(lambda name: rows.filter(~new) if name == "diagnostic_assessment_students" else t.table(name))
    store = ImprovementStore(rows.sparkSession, staged_path(rows.sparkSession, "improvement"), parts=8, **options)
    store.build(before)
    store.refresh(t, rows.filter(new))
    return store


def _written_logins(t: TableSet) -> DataFrame:
    """The login figures of the job that writes the logins; a teacher is one row."""
    rows = _logins(t)
    figures = write_with_figures(rows, staged_path(rows.sparkSession, "logins"), {
        "total_logins": F.count("id_professor"),
        "total_onboardings": F.count_if((F.col("onboarding_completo") == 1) & F.col("id_professor").isNotNull()),
    })
    return rows.sparkSession.createDataFrame([figures], "total_logins long, total_onboardings long")


_TEXT_IDS = ["id_professor", "id_turma", "ano_turma", "id_aluno", "cod_inep", "id_avaliacao"]

_QUERIES: dict[str, Callable[[TableSet], DataFrame]] = {
    # reports
    "logins": _logins,
    "onboardings_total": lambda t: logins.onboardings_total(t, EXCLUDED),
    "students_total": logins.students_total,
    "diagnostics_total": logins.diagnostics_total,
    "classes_total": logins.classes_total,
    "students_by_class": roster.students_by_class,
    "student_evolution": levels.student_evolution,
    "evolved_students_count": levels.evolved_students_count,
    "evolved_students_distinct": levels.evolved_students_distinct,
    "teachers_multi_class": levels.teachers_multi_class,
    "classes_multi_assessment": levels.classes_multi_assessment,
    "hypothesis_history": levels.hypothesis_history,
    "class_improvement_total": improvement.class_improvement,
    "questionnaire_answers": _answers,
    "teacher_class_student": _roster,
    "registered_classes": _registered,
    "class_improvement_by_month": _by_month,
    "class_improvement_by_month_assessed": _by_month_assessed,
    # logins
    "login_kpis": lambda t: logins.login_kpis(_logins(t)),
    "logins_per_day": lambda t: logins.logins_per_day(_logins(t)),
    "onboardings_per_day": lambda t: logins.onboardings_per_day(_logins(t)),
    "onboarded_teachers": lambda t: logins.onboarded_teachers(_logins(t)),
    # questionnaire
    "answered_all": lambda t: questionnaire.answered_all(_answers(t)),
    "answered_partly": lambda t: questionnaire.answered_partly(_answers(t)),
    "questionnaire_kpis": lambda t: questionnaire.questionnaire_kpis(_answers(t)),
    "answer_summary": lambda t: questionnaire.answer_summary(_answers(t)),
    "answer_summary_recoded": lambda t: questionnaire.answer_summary_recoded(_answers(t), ANSWER_LABELS),
    "question_series": lambda t: questionnaire.question_series(
        questionnaire.answer_summary_recoded(_answers(t), ANSWER_LABELS), "Q3"
    ),
    # teachers, classes, students
    "teacher_kpis": lambda t: roster.teacher_kpis(_roster(t)),
    "teachers_per_day": lambda t: roster.teachers_per_day(_roster(t)),
    "registration_spread": lambda t: roster.registration_spread(_roster(t)),
    "state_order": lambda t: roster.state_order(_roster(t)),
    "teachers_by_state": lambda t: roster.teachers_by_state(_roster(t)),
    "classes_by_state": lambda t: roster.classes_by_state(_roster(t)),
    "classes_by_state_total": lambda t: roster.classes_by_state_total(roster.classes_by_state(_roster(t))),
    "onboarding_rate": lambda t: roster.onboarding_rate(_roster(t)),
    "state_filtered": lambda t: state_filter(_roster(t), STATES),
    "teachers_by_state_filtered": lambda t: roster.teachers_by_state(_roster(t), states=STATES),
    "classes_by_state_filtered": lambda t: roster.classes_by_state(_roster(t), states=[*STATES, None]),
    "state_choices": lambda t: roster.state_choices(_roster(t)),
    "key_violations": check_keys,
    "state_filtered_kpis": lambda t: roster.teacher_kpis(state_filter(_roster(t), STATES)),
    "class_kpis": lambda t: roster.class_kpis(_registered(t)),
    "class_teachers_per_day": lambda t: roster.teachers_per_day(_registered(t)),
    "student_class_kpis": lambda t: roster.student_class_kpis(roster.assessed_students(t)),
    "first_hypothesis_counts": roster.first_hypothesis_counts,
    "ids_as_text": lambda t: ids_as_text(roster.students_by_class(t), _TEXT_IDS),
    # display order: places without a sort in one task
    "roster_sorted": lambda t: _in_order(_roster(t), *roster.ROSTER_KEYS),
    "history_sorted": lambda t: _in_order(levels.hypothesis_history(t), "student_id", "rn"),
    "pairing_sorted": lambda t: roster.students_by_class(t, store=lambda parts: _in_order(
        parts, F.desc("data_criacao_avaliacao"), "id_avaliacao", "id_aluno", "hipotese", slice_rows=SORTED_PAIRS
    )),
    # counts that add up, and all series in one pass
    "teachers_per_month": lambda t: rolled_up(_teacher_days(t), [F.date_trunc("month", DAY)], "total_professores")
    .withColumnRenamed("_g0", "mes").withColumn("mes", F.to_date("mes")),
    "classes_by_state_rolled": lambda t: rolled_up(_teacher_days(t, "id_turma", "estado_escola"), ["estado_escola"], "total_turmas"),
    "students_rolled": lambda t: rolled_up(_teacher_days(t, "id_aluno", "estado_escola"), name="total_alunos"),
    "roster_series": lambda t: series.roster_series(_roster(t)),
    "improvement_series": lambda t: series.improvement_series(_by_month(t)),
    # stored tables and results
    "student_evolution_stored": lambda t: levels.student_evolution(_by_student(t)),
    "class_improvement_total_stored": lambda t: improvement.class_improvement(_by_student(t)),
    "class_improvement_refreshed": lambda t: _refreshed(t).report(),
    "class_improvement_by_month_refreshed": lambda t: _refreshed(t, by_month=True, excluded=EXCLUDED).report(),
    "login_kpis_written": _written_logins,
    # level changes as numbers
    "evolved_students_n": levels.evolved_students_n,
    "teachers_multi_class_n": levels.teachers_multi_class_n,
    "classes_multi_assessment_n": levels.classes_multi_assessment_n,
    # improvement
    "improvement_kpis": lambda t: improvement.improvement_kpis(_by_month(t)),
    "improvement_kpis_assessed": lambda t: improvement.improvement_kpis(_by_month_assessed(t)),
    "rows_by_month": lambda t: improvement.rows_by_month(_by_month(t)),
    "teachers_by_month": lambda t: improvement.teachers_by_month(_by_month(t)),
    "classes_by_month": lambda t: improvement.classes_by_month(_by_month(t)),
    "improved_classes_by_state": lambda t: improvement.improved_classes_by_state(_by_month(t)),
    "mean_improvement_by_month": lambda t: improvement.mean_improvement_by_month(_by_month(t)),
    "mean_improvement_by_state": _mean_by_state,
    "top5_states": lambda t: improvement.top_states(_mean_by_state(t)),
    "overall_improvement_rate": lambda t: improvement.overall_improvement_rate(improvement.class_improvement(t)),
    # filters and type repairs
    "filter_profile": lambda t: _profile_text(profile_columns(_roster(t))),
    "filter_profile_merged": _merged_profile,
    "filter_profile_exact": lambda t: _profile_text(profile_columns(_logins(t), exact_counts=True)),
    "filter_in": lambda t: apply_filters(
        _roster(t), [FilterSpec("cidade_escola", CATEGORICAL, values=["ASIA", "EUROPE", None])]
    ),
    "filter_range_num": lambda t: apply_filters(
        improvement.class_improvement(t), [FilterSpec("porcentagem_melhoria", NUMERIC, lo=25.0, hi=50.0)]
    ),
    "filter_in_default": lambda t: apply_filters(_registered(t), [FilterSpec("cidade_escola", CATEGORICAL)]),
    "filter_range_num_open": lambda t: apply_filters(
        improvement.class_improvement(t), [FilterSpec("porcentagem_melhoria", NUMERIC, lo=50.0)]
    ),
    "filter_range_date": lambda t: apply_filters(
        _logins(t), [FilterSpec("data_criacao", DATETIME, lo=date(2024, 1, 5), hi=date(2024, 1, 15))]
    ),
    "filter_text": lambda t: apply_filters(
        _registered(t), [FilterSpec("estado_escola", TEXT, pattern="_1[0-4]$")]
    ),
    "chained_filters": lambda t: apply_filters(_roster(t), CHAIN),
    "filter_facets": lambda t: _profile_text(filter_facets(_roster(t), CHAIN)),
    "normalize_ints": _integers,
    "format_integers": lambda t: normalize_ints(_as_doubles(roster.students_by_class(t, store=_stored), *_TEXT_IDS)),
    "fill_null_numeric": lambda t: fill_null_numeric(_roster(t)),
    "infer_dates": lambda t: infer_dates(_month_starts(t)),
    "strip_tz": _zoned,
}


def entry(spark: SparkSession) -> DataFrame:
    """Share of each class that improved, by month."""
    return _by_month(sample_tables(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(query: Callable[[TableSet], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(sample_tables(spark, sf_dir))

    registered = {name: bound(query) for name, query in _QUERIES.items()}
    if text_queries:
        registered |= text_queries.QUERIES
    if corpus_pipeline:
        registered["pipeline"] = corpus_pipeline.run
    return registered


def oracle_sql() -> dict[str, str]:
    twins = oracle_queries()
    if text_queries:
        twins |= text_queries.ORACLES
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    return twins
