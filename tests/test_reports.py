"""Hand-made rows for the rules that the test tables cannot show."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from levelbook.functions.vocabulary import ANSWERED_ALL, ANSWERED_PARTLY, CHALLENGE_LABELS, MONTH_NAMES
from levelbook.plans import improvement, levels, logins, questionnaire, roster

DAY = datetime(2024, 3, 1)


def at(day: int, hour: int = 0, minute: int = 0, second: int = 0, micro: int = 0) -> datetime:
    return datetime(2024, 3, day, hour, minute, second, micro)


def levels_of(*pairs):
    return [dict(id=i, name=name, ordering=ordering) for i, (name, ordering) in enumerate(pairs, 1)]


def got(student, level, assessment=None, **more):
    return dict(student_id=student, hypothesis_id=level, diagnostic_assessment_id=assessment, **more)


def dicts(df):
    return [row.asDict() for row in df.collect()]


# accounts

def test_unknown_accounts_are_left_out(make_tables):
    t = make_tables(teacher=[dict(id=i, auth_id=a, onboarding_completed=1) for i, a in [(1, "a"), (2, None), (3, "x")]])
    assert [r.id_professor for r in logins.logins(t, ["x"]).collect()] == [1]
    assert logins.onboardings_total(t, ["x"]).first()[0] == 1
    assert logins.logins(t, []).count() == logins.logins(t, [None]).count() == 2


def test_accounts_as_a_frame(make_tables, spark):
    t = make_tables(teacher=[dict(id=i, auth_id=a) for i, a in [(1, "a"), (2, None), (3, "x"), (4, "y")]])
    listed = spark.createDataFrame([("x",), (None,), ("x",)], "account string")
    assert sorted(r.id_professor for r in logins.logins(t, listed).collect()) == [1, 4]


def test_onboardings_count_rows_and_take_their_own_list(make_tables):
    t = make_tables(teacher=[
        dict(id=1, auth_id="a", onboarding_completed=1),
        dict(id=2, auth_id="b", onboarding_completed=1),
        dict(id=3, auth_id="b", onboarding_completed=0),
    ])
    assert logins.onboardings_total(t, ["a"]).first()[0] == 1
    assert logins.login_kpis(logins.logins(t, ["b"])).first()[1] == 1


def test_per_day_drops_missing_dates(make_tables):
    t = make_tables(teacher=[
        dict(id=1, auth_id="a", created_at=at(1, 0)), dict(id=2, auth_id="b", created_at=at(1, 23, 59)),
        dict(id=3, auth_id="c", created_at=at(2)), dict(id=4, auth_id="d"),
    ])
    rows = {str(r.data_criacao): r.total_professores for r in logins.logins_per_day(logins.logins(t, [])).collect()}
    assert rows == {"2024-03-01": 2, "2024-03-02": 1}


# roster

@pytest.fixture
def school_tables(make_tables):
    return make_tables(
        teacher=[dict(id=i, auth_id=str(100 + i), onboarding_completed=i % 2, created_at=at(1 + i % 2, i)) for i in range(1, 6)],
        **{"class": [
            dict(id=10, teacher_id=2, cod_inep=1), dict(id=11, teacher_id=1, cod_inep=2),
            dict(id=12, teacher_id=1, cod_inep=None), dict(id=13, teacher_id=3, cod_inep=99),
            dict(id=14, teacher_id=None, cod_inep=1), dict(id=15, teacher_id=77, cod_inep=1),
        ]},
        student=[dict(id=s, class_id=c) for s, c in [(1, 10), (2, 10), (3, 11), (4, 12), (5, 14), (6, None), (7, 15)]],
        school=[dict(cod_inep=1, name="E1", municipio="M", uf="SP"), dict(cod_inep=2, name="E2", municipio="M", uf="AC")],
    )


def test_outer_roster_keeps_what_is_missing(school_tables):
    rows = roster.teacher_class_student(school_tables, [])
    keys = sorted((r.id_professor, r.id_turma or 0, r.id_aluno or 0, r.estado_escola or "") for r in rows.collect())
    assert keys == [
        (1, 11, 3, "AC"), (1, 12, 4, ""), (2, 10, 1, "SP"), (2, 10, 2, "SP"), (3, 13, 0, ""), (4, 0, 0, ""), (5, 0, 0, ""),
    ]
    flags = {r.id_professor: (r.flag_turma, r.flag_onboarding) for r in rows.collect()}
    assert flags[5] == ("Sem Turma", "Onboarding Completo") and flags[2] == ("Tem Turma", "Onboarding Não Completo")


def test_inner_roster_is_part_of_the_outer(school_tables):
    inner = roster.teacher_class_student(school_tables, [], how="inner")
    outer = roster.teacher_class_student(school_tables, []).select(*inner.columns)
    assert inner.count() == 3
    assert inner.exceptAll(outer).count() == 0


def test_roster_order(school_tables):
    rows = roster.teacher_class_student(school_tables, [], ordered=True).collect()
    keys = [(r.id_professor, r.id_turma or 0, r.id_aluno or 0) for r in rows]
    assert keys == sorted(keys)


def test_states_rank_by_first_appearance(school_tables):
    rows = roster.teacher_class_student(school_tables, [])
    assert {r.estado_escola: r.ordem for r in roster.state_order(rows).collect()} == {"AC": 0, "SP": 1}
    # The order of all rows also ranks a selection.
    chosen = rows.filter(F.col("estado_escola") == "SP")
    assert dicts(roster.teachers_by_state(chosen, rows)) == [dict(estado_escola="SP", total_professores=1, ordem=1)]


def test_classes_without_a_state_are_counted_last(school_tables):
    by_state = roster.classes_by_state(roster.teacher_class_student(school_tables, []))
    found = {r.estado_escola: (r.total_turmas, r.ordem) for r in by_state.collect()}
    assert found == {"AC": (1, 0), "SP": (1, 1), "Não informado": (2, 2)}
    assert roster.classes_by_state_total(by_state).first()[0] == 4


def test_teacher_kpis_skip_the_filled_id(spark):
    rows = spark.createDataFrame([(0, 1, 0), (1, 0, None), (2, 0, 5)], "id_professor long, id_turma long, id_aluno long")
    assert tuple(roster.teacher_kpis(rows).first()) == (2, 1, 1)


def test_kpis_of_one_column_under_conditions(spark):
    from levelbook.operators.counts import distinct_kpis
    rows = spark.createDataFrame([(1, 1), (1, None), (2, 0), (3, None), (None, 1)], "id long, ok int")
    kpis = {"all": "id", "good": ("id", F.col("ok") == 1), "bad": ("id", F.col("ok") == 0)}
    assert tuple(distinct_kpis(rows, kpis).first()) == (3, 1, 1)
    assert tuple(distinct_kpis(rows.limit(0), kpis).first()) == (0, 0, 0)
    assert tuple(distinct_kpis(rows, {**kpis, "oks": "ok"}).first()) == (3, 1, 1, 2)


def test_spread_is_a_range_in_minutes(spark):
    rows = spark.createDataFrame(
        [(at(1, 10, 0, 0, 250000),), (at(1, 11, 30),), (at(1, 10, 30),), (at(2),), (None,)], "data_cadastro_professor timestamp_ntz"
    )
    spread = {r[0].day: r[1] for r in roster.registration_spread(rows).collect()}
    assert spread[2] == 0.0 and spread[1] == pytest.approx(90 - 0.25 / 60, abs=1e-9)


def test_onboarding_rate_without_teachers(make_tables):
    empty = roster.onboarding_rate(roster.teacher_class_student(make_tables(), []))
    assert tuple(empty.first()) == (0, 0, 0.0, 0)


# students by class

def pairing_tables(make_tables):
    return make_tables(
        teacher=[dict(id=1)],
        **{"class": [dict(id=10, teacher_id=1, cod_inep=1), dict(id=11, teacher_id=1, cod_inep=None)]},
        student=[dict(id=1, class_id=10, name="A"), dict(id=2, class_id=10, name="B"), dict(id=3, class_id=11, name="C")],
        school=[dict(cod_inep=1, uf="SP")],
        diagnostic_assessment=[
            dict(id=100, teacher_id=1, class_id=10, month="3", created_at=at(1)),
            dict(id=101, teacher_id=1, class_id=10, month="4", created_at=at(2)),
            dict(id=102, teacher_id=9, class_id=10, month="5", created_at=at(3)),
            dict(id=103, teacher_id=1, class_id=11, month="5", created_at=at(3)),
        ],
        diagnostic_assessment_type_hypothesis=levels_of(("z", 1), ("y", 2), (None, 3)),
        diagnostic_assessment_students=[
            got(1, 1, 100, comment="a"), got(1, 1, 100, comment="b"), got(1, 2, 999), got(2, 3, 101), got(2, 2, 101), got(3, 1, 103),
        ],
    )


def test_levels_pair_with_every_assessment_of_the_class(make_tables):
    t = pairing_tables(make_tables)
    rows = roster.students_by_class(t).collect()
    found = sorted((r.id_avaliacao, r.id_aluno, r.hipotese, r.comentario) for r in rows)
    assert found == sorted(
        (a, s, h, c) for a in (100, 101) for s, h, c in [(1, 1, "b"), (1, 2, None), (2, 3, None), (2, 2, None)]
    )
    newest = roster.students_by_class(t, ordered=True).first()
    assert newest.id_avaliacao == 101


def test_figures_without_the_pairs_are_the_same(make_tables):
    t = pairing_tables(make_tables)
    pairs = roster.students_by_class(t)
    assert tuple(roster.student_class_kpis(roster.assessed_students(t)).first()) == tuple(roster.student_class_kpis(pairs).first())
    # Student 2 has the larger level without a name, which is passed over.
    assert dicts(roster.first_hypothesis_counts(t)) == [dict(nome_hipotese="y", count=2)]


# levels

def test_evolution_takes_names_by_text_and_falls_count(make_tables):
    t = make_tables(
        student=[dict(id=1, name="A"), dict(id=2, name="B")],
        diagnostic_assessment_type_hypothesis=levels_of(("zeta", 1), ("alfa", 4)),
        diagnostic_assessment_students=[
            got(1, 2, created_at=at(1)), got(1, 1, created_at=at(5)),
            got(2, 1, created_at=at(1)), got(2, 1, created_at=at(2)),
            got(9, 1, created_at=at(1)), got(9, 2, created_at=at(2)),
            got(8, 1, created_at=at(1)), got(8, 2, created_at=at(1)), got(8, 2),
        ],
    )
    assert dicts(levels.student_evolution(t, ordered=True)) == [dict(
        id_aluno=1, nome_aluno="A", ordem_inicial=1, ordem_final=4,
        estado_inicial="alfa", estado_final="zeta", data_inicial=at(1), data_final=at(5),
    )]
    # The count also takes unknown students, but needs two dates.
    assert levels.evolved_students_count(t).first()[0] == 2
    assert levels.evolved_students_n(t).first()[0] == 1


def test_several_classes_and_assessments(make_tables):
    t = make_tables(
        teacher=[dict(id=1), dict(id=2)],
        **{"class": [dict(id=i, teacher_id=teacher) for i, teacher in [(1, 1), (2, 1), (3, 2), (4, 7), (5, 7), (6, None), (7, None)]]},
        diagnostic_assessment=[dict(id=i, class_id=c) for i, c in [(1, 1), (2, 1), (3, 2), (4, None), (5, None)]],
    )
    assert levels.teachers_multi_class_n(t).first()[0] == 1
    assert sorted(r[0] for r in levels.classes_multi_assessment(t).collect()) == [0, 1]
    assert tuple(levels.classes_multi_assessment_n(t).first()) == (1, 2)


def test_history_numbers_ties_by_assessment_and_level(make_tables):
    t = make_tables(
        **{"class": [dict(id=1, cod_inep=1), dict(id=2)]},
        student=[dict(id=1, class_id=1), dict(id=2, class_id=2)],
        school=[dict(cod_inep=1)],
        diagnostic_assessment=[dict(id=5, created_at=at(2)), dict(id=4, created_at=at(2)), dict(id=6, created_at=at(1))],
        diagnostic_assessment_type_hypothesis=levels_of(("a", 1), ("b", 2), ("c", 3)),
        diagnostic_assessment_students=[got(1, 2, 5), got(1, 1, 5), got(1, 3, 4), got(1, 3, 6), got(1, 1, 99), got(1, 9, 6), got(2, 1, 5), got(None, 1, 5)],
    )
    rows = levels.hypothesis_history(t, ordered=True).collect()
    assert [(r.student_id, r.nome_hipotese, r.created_at, r.rn) for r in rows] == [
        (1, "c", at(1), 1), (1, "c", at(2), 2), (1, "a", at(2), 3), (1, "b", at(2), 4),
    ]


# improvement

def improvement_tables(make_tables, **changes):
    rows = dict(
        teacher=[dict(id=1, auth_id="a"), dict(id=2, auth_id="x"), dict(id=3)],
        **{"class": [
            dict(id=1, teacher_id=1, cod_inep=1, name="T1", year=2024), dict(id=2, teacher_id=2, cod_inep=1),
            dict(id=3, teacher_id=3, cod_inep=1), dict(id=4, teacher_id=1, cod_inep=None),
        ]},
        school=[dict(cod_inep=1, uf="SP")],
        student=[dict(id=i, class_id=c) for i, c in [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 3), (7, 4)]],
        diagnostic_assessment=[
            dict(id=1, month="3", created_at=at(3)), dict(id=2, month="04", created_at=at(4)),
            dict(id=3, month="x", created_at=at(9)), dict(id=4, month="5", created_at=at(4)),
        ],
        diagnostic_assessment_type_hypothesis=levels_of(("a", 1), ("b", 2)),
        diagnostic_assessment_students=[
            got(1, 1, 1), got(1, 2, 2), got(2, 2, 1), got(2, 1, 4), got(2, 1, 2), got(3, 1, 1),
            got(5, 1, 1), got(5, 2, 1), got(6, 1, 1), got(6, 2, 1), got(7, 1, 1), got(7, 2, 1),
        ],
    )
    return make_tables(**{**rows, **changes})


def test_total_improvement_has_no_account_list_and_needs_no_school(make_tables):
    rows = improvement.class_improvement(improvement_tables(make_tables)).collect()
    found = {r.turma_id: (r.professor_id, r.total_alunos, r.alunos_com_melhoria, r.porcentagem_melhoria) for r in rows}
    assert found == {1: (1, 4, 2, 50.0), 2: (2, 1, 1, 100.0), 3: (3, 1, 1, 100.0), 4: (1, 1, 1, 100.0)}


def test_monthly_improvement_uses_the_latest_month(make_tables):
    t = improvement_tables(make_tables)
    rows = improvement.class_improvement(t, by_month=True, excluded=["x"])
    found = sorted((r.id_turma, r.mes_sondagem, r.total_alunos, r.alunos_com_melhoria, r.porcentagem_melhoria) for r in rows.collect())
    # Student 2's two latest assessments share a date: the larger id decides.
    assert found == [(1, "Abril", 4, 1, 25.0), (1, "Maio", 4, 1, 25.0)]
    assessed = improvement.class_improvement(t, by_month=True, denominator="assessed", excluded=["x"])
    assert {(r.total_alunos, r.porcentagem_melhoria) for r in assessed.collect()} == {(2, 50.0)}


def test_unreadable_months_have_no_name(make_tables):
    t = improvement_tables(make_tables, diagnostic_assessment=[
        dict(id=1, month="x", created_at=at(3)), dict(id=2, month="13", created_at=at(4)), dict(id=4, month=None, created_at=at(5)),
    ])
    rows = improvement.class_improvement(t, by_month=True, excluded=["x"]).collect()
    assert sorted((r.mes_sondagem, r.alunos_com_melhoria) for r in rows) == [(None, 1), (None, 1)]
    by_month = improvement.rows_by_month(improvement.class_improvement(t, by_month=True, excluded=[]))
    assert by_month.count() == 0


def test_month_text():
    assert MONTH_NAMES[2] == "Março" and len(set(MONTH_NAMES)) == 12


@pytest.mark.parametrize("text,number", [("3", 3), ("03", 3), (" 7", 7), ("11x", 11), ("x", 0), ("", 0), (None, None), ("-1", 0), ("5.7", 5)])
def test_month_number_from_text(spark, text, number):
    from levelbook.functions.columns import month_number_from_text
    df = spark.createDataFrame([(text,)], "m string")
    assert df.select(month_number_from_text(F.col("m"))).first()[0] == number


def test_percentage_rounds_halves_up(spark):
    from levelbook.functions.columns import percentage
    df = spark.createDataFrame([(41, 800), (1, 3), (2, 3), (201, 20000), (1, 0)], "k long, n long")
    assert [r[0] for r in df.select(percentage(F.col("k"), F.col("n"))).collect()] == [5.13, 33.33, 66.67, 1.01, None]


def test_class_sums_count_once_per_month_row(spark):
    rows = spark.createDataFrame(
        [(1, 10, 4, 2, 50.0), (1, 10, 4, 1, 25.0), (2, 11, 5, 1, 20.0)],
        "id_professor long, id_turma long, total_alunos long, alunos_com_melhoria long, porcentagem_melhoria double",
    )
    assert tuple(improvement.improvement_kpis(rows).first()) == (2, 2, 13, 4, 1)
    assert tuple(improvement.improvement_kpis(rows.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert tuple(improvement.overall_improvement_rate(rows.limit(0)).first()) == (0, 0, 0.0)


@pytest.mark.parametrize("kind, values, mean", [
    ("double", [0.004, 0.004], 0.004), ("double", [0.1] * 10, 0.1), ("decimal(9,4)", ["0.0004", "0.0006"], 0.0005),
    ("long", [10**17, 10**17 + 2], 1e17 + 1), ("double", [None, 2.5], 2.5),
])
def test_means_keep_all_digits(spark, kind, values, mean):
    from levelbook.operators.counts import mean_per

    rows = spark.createDataFrame([("a", None if v is None else str(v)) for v in values], "k string, v string")
    found = mean_per(rows.withColumn("v", F.col("v").cast(kind)), "k", "v").first()
    assert found["v"] == mean


def test_a_school_stored_twice_gives_one_row(make_tables):
    t = make_tables(
        teacher=[dict(id=1, auth_id="a")], **{"class": [dict(id=2, teacher_id=1, cod_inep=3)]},
        student=[dict(id=4, class_id=2)], school=[dict(cod_inep=3, uf="SP"), dict(cod_inep=3, uf="SP")],
        diagnostic_assessment=[dict(id=5, teacher_id=1, class_id=2)],
        diagnostic_assessment_type_hypothesis=[dict(id=6, name="n", ordering=1)],
        diagnostic_assessment_students=[dict(student_id=4, diagnostic_assessment_id=5, hypothesis_id=6)],
    )
    assert roster.students_by_class(t).count() == 1
    assert roster.assessed_students(t).count() == 1


def test_top_states_break_ties_by_name(spark):
    by_state = spark.createDataFrame([(s, 10.0) for s in "FEDCBA"] + [("Z", 99.0)], "estado_escola string, porcentagem_melhoria double")
    assert [r[0] for r in improvement.top_states(by_state).collect()] == ["Z", "A", "B", "C", "D"]


def test_months_sort_as_text_or_by_calendar(spark):
    from levelbook.functions.columns import month_number
    rows = spark.createDataFrame([(m,) for m in ("Março", "Abril", None, "Agosto", "Março")], "mes_sondagem string")
    assert [tuple(r) for r in improvement.rows_by_month(rows, ordered=True).collect()] == [("Abril", 1), ("Agosto", 1), ("Março", 2)]
    calendar = improvement.rows_by_month(rows).orderBy(month_number(F.col("mes_sondagem")))
    assert [r[0] for r in calendar.collect()] == ["Março", "Abril", "Agosto"]


# questionnaire

def questionnaire_tables(make_tables):
    return make_tables(
        teacher=[dict(id=1, auth_id="a"), dict(id=2, auth_id="b"), dict(id=3, auth_id="x"), dict(id=4)],
        questionnaire_type=[dict(id=1, name="Onboarding"), dict(id=2, name="Outro")],
        questionnaire=[dict(id=1, type_id=1), dict(id=2, type_id=2), dict(id=3, type_id=9)],
        questionnaire_question=[dict(id=1, label="P1"), dict(id=2, label=None)],
        questionnaire_response=[
            dict(id=1, teacher_id=1, questionnaire_id=1, created_at=at(1)), dict(id=2, teacher_id=1, questionnaire_id=2),
            dict(id=3, teacher_id=2, questionnaire_id=1), dict(id=4, teacher_id=3, questionnaire_id=1),
            dict(id=5, teacher_id=4, questionnaire_id=1), dict(id=6, teacher_id=2, questionnaire_id=3),
        ],
        questionnaire_answer=[
            dict(id=1, response_id=1, question_id=1, value="s"), dict(id=2, response_id=2, question_id=1), dict(id=3, response_id=2, question_id=2),
            dict(id=4, response_id=3, question_id=1, value="s"), dict(id=5, response_id=3, question_id=2, value="n"), dict(id=6, response_id=3, question_id=8),
            dict(id=7, response_id=6, question_id=1), dict(id=8, response_id=4, question_id=1), dict(id=9, response_id=5, question_id=1), dict(id=10, response_id=77, question_id=1),
        ],
    )


def test_status_counts_all_types_but_known_questions_only(make_tables):
    rows = questionnaire.questionnaire_answers(questionnaire_tables(make_tables), ["x"])
    assert sorted((r.id_professor, r.pergunta or "", r.resposta, r.status_resposta) for r in rows.collect()) == [
        (1, "P1", "s", ANSWERED_ALL), (2, "", "n", ANSWERED_PARTLY), (2, "P1", "s", ANSWERED_PARTLY),
    ]
    assert tuple(questionnaire.questionnaire_kpis(rows).first()) == (1, 1)
    # The answer to the question without a label is in the detail, not in the summary.
    summary = questionnaire.answer_summary(questionnaire.answered_partly(rows))
    assert dicts(summary) == [dict(status_resposta=ANSWERED_PARTLY, pergunta="P1", resposta="s", count=1)]


def test_answers_of_another_type(make_tables):
    rows = questionnaire.questionnaire_answers(questionnaire_tables(make_tables), [], type_name="Outro", min_answers=4)
    assert sorted((r.id_professor, r.status_resposta) for r in rows.collect()) == [(1, ANSWERED_PARTLY)] * 2


def test_labels_replace_exact_values_only(spark):
    from levelbook.operators.counts import recode
    long = "Falta de conhecimento sobre sondagem"
    df = spark.createDataFrame([(long,), (long + "!",), (None,)], "r string")
    assert [r.d for r in recode(df, "r", CHALLENGE_LABELS, "d").collect()] == [CHALLENGE_LABELS[long], long + "!", None]
    assert [r.r for r in recode(df, "r", {}).collect()] == [long, long + "!", None]
