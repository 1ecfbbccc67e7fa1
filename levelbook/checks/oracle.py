"""One DuckDB query per registered query, written straight from the meaning of the result.

They share no shape with the Spark plans: no early grouping, no slices, no split of outer
joins. ``REPORTS`` holds the reports, each as a chain of CTEs ending in ``report``;
``oracle_sql`` adds the summaries on top of them.
"""

from __future__ import annotations

from levelbook.checks.sample import EXCLUDED, sample_ctes
from levelbook.sources import KEYS
from levelbook.functions.vocabulary import (
    ALL_STATES,
    ANSWERED_ALL,
    ANSWERED_PARTLY,
    HAS_CLASS,
    MONTH_NAMES,
    NO_CLASS,
    ONBOARDING_DONE,
    ONBOARDING_OPEN,
    UNKNOWN_STATE,
)

_OUT = "(" + ", ".join(f"'{a}'" for a in EXCLUDED) + ")"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + "]"

_T, _C, _S, _SC = "teacher", "class", "student", "school"
_DA, _DAS, _DH = "diagnostic_assessment", "diagnostic_assessment_students", "diagnostic_assessment_type_hypothesis"
_Q = ("questionnaire_type", "questionnaire", "questionnaire_question", "questionnaire_response", "questionnaire_answer")

# Every student's level rows with its class and teacher; by month also the assessment.
_CLASS_LEVELS = r"""
levels AS (
    SELECT s.id AS sid, s.class_id AS cid, h.ordering AS lvl, a.id AS aid, a.created_at AS given, a.month AS month
    FROM student s, class k, teacher t, diagnostic_assessment_students x,
         diagnostic_assessment_type_hypothesis h, diagnostic_assessment a
    WHERE x.student_id = s.id AND k.id = s.class_id AND t.id = k.teacher_id
      AND h.id = x.hypothesis_id AND a.id = x.diagnostic_assessment_id
),
latest AS (
    SELECT sid, coalesce(TRY_CAST(regexp_extract(month, '^\s*\+?(\d+)', 1) AS INT),
                         CASE WHEN month IS NOT NULL THEN 0 END) AS month
    FROM levels
    QUALIFY row_number() OVER (PARTITION BY sid ORDER BY given DESC NULLS LAST, aid DESC) = 1
),
risen AS (
    SELECT cid, month, count(*) AS up
    FROM (SELECT sid, cid FROM levels GROUP BY sid, cid HAVING max(lvl) > min(lvl)) JOIN latest USING (sid)
    GROUP BY cid, month
)"""


def _percent(part: str, whole: str) -> str:
    """Hundredths of a percent in whole numbers, halves up; the only rounding is the last division."""
    return f"((20000 * ({part}) + ({whole})) // (2 * ({whole}))) / 100"


def _by_month(size: str) -> str:
    return f"""{_CLASS_LEVELS},
size AS ({size}),
report AS (
    SELECT k.id AS id_turma, k.cod_inep AS cod_inep_turma, k.name AS nome_turma, k.year AS ano_turma,
           e.name AS nome_escola, e.municipio AS cidade_escola, e.uf AS estado_escola,
           k.teacher_id AS id_professor, size.n AS total_alunos, risen.up AS alunos_com_melhoria,
           {_percent("risen.up", "size.n")} AS porcentagem_melhoria,
           CASE WHEN risen.month BETWEEN 1 AND 12 THEN {_MONTHS}[risen.month] END AS mes_sondagem
    FROM risen JOIN class k ON k.id = risen.cid JOIN size ON size.cid = risen.cid
    JOIN school e USING (cod_inep) JOIN teacher t ON t.id = k.teacher_id
    WHERE t.auth_id NOT IN {_OUT}
)"""


_ROSTER = f"""
report AS (
    SELECT t.id AS id_professor, t.auth_id AS id_nova_escola, t.created_at AS data_cadastro_professor,
           if(t.onboarding_completed = 1, '{ONBOARDING_DONE}', '{ONBOARDING_OPEN}') AS flag_onboarding,
           if(k.id IS NULL, '{NO_CLASS}', '{HAS_CLASS}') AS flag_turma,
           k.id AS id_turma, k.name AS nome_turma, k.year AS ano_turma, k.created_at AS data_cadastro_turma,
           s.id AS id_aluno, s.name AS nome_aluno,
           e.name AS nome_escola, e.municipio AS cidade_escola, e.uf AS estado_escola,
           s.created_at AS data_cadastro_aluno
    FROM (SELECT * FROM teacher WHERE auth_id NOT IN {_OUT}) t
    LEFT JOIN class k ON k.teacher_id = t.id
    LEFT JOIN school e ON e.cod_inep = k.cod_inep
    LEFT JOIN student s ON s.class_id = k.id
)"""

# name -> (tables, CTEs that end in "report")
REPORTS: dict[str, tuple[tuple[str, ...], str]] = {
    "logins": ((_T,), f"""
report AS (
    SELECT DISTINCT id AS id_professor, auth_id AS id_nova_escola, confirmed AS confirmado, active AS ativo,
           created_at AS data_criacao, updated_at AS data_atualizacao, onboarding_completed AS onboarding_completo
    FROM teacher WHERE auth_id NOT IN {_OUT}
)"""),
    "students_by_class": ((_T, _C, _S, _SC, _DA, _DAS, _DH), """
report AS (
    SELECT a.teacher_id AS id_professor, k.id AS id_turma, k.name AS nome_turma, k.year AS ano_turma,
           s.id AS id_aluno, s.name AS nome_aluno, e.cod_inep, e.name AS nome_escola,
           e.municipio AS cidade_escola, e.uf AS estado_escola, a.id AS id_avaliacao, a.month AS mes_avaliacao,
           h.id AS hipotese, h.name AS nome_hipotese,
           max(x.comment) AS comentario, max(a.created_at) AS data_criacao_avaliacao
    FROM diagnostic_assessment_students x
    JOIN diagnostic_assessment_type_hypothesis h ON h.id = x.hypothesis_id
    JOIN student s ON s.id = x.student_id
    JOIN class k ON k.id = s.class_id
    JOIN school e ON e.cod_inep = k.cod_inep
    JOIN diagnostic_assessment a ON a.class_id = k.id
    WHERE EXISTS (SELECT 1 FROM teacher t WHERE t.id = a.teacher_id)
    GROUP BY ALL
)"""),
    "student_evolution": ((_S, _DAS, _DH), """
report AS (
    SELECT s.id AS id_aluno, s.name AS nome_aluno, min(h.ordering) AS ordem_inicial, max(h.ordering) AS ordem_final,
           min(h.name) AS estado_inicial, max(h.name) AS estado_final,
           min(x.created_at) AS data_inicial, max(x.created_at) AS data_final
    FROM student s, diagnostic_assessment_students x, diagnostic_assessment_type_hypothesis h
    WHERE x.student_id = s.id AND h.id = x.hypothesis_id
    GROUP BY ALL
    HAVING count(DISTINCT h.ordering) > 1
)"""),
    "hypothesis_history": ((_C, _S, _SC, _DA, _DAS, _DH), """
report AS (
    SELECT s.id AS student_id, s.name AS nome_aluno, k.name AS nome_turma, k.year AS ano_turma, e.cod_inep,
           e.name AS nome_escola, e.municipio AS cidade_escola, e.uf AS estado_escola, h.name AS nome_hipotese,
           a.created_at, row_number() OVER (PARTITION BY s.id ORDER BY a.created_at NULLS FIRST, a.id, h.id) AS rn
    FROM student s
    JOIN class k ON k.id = s.class_id
    JOIN school e USING (cod_inep)
    JOIN diagnostic_assessment_students x ON x.student_id = s.id
    JOIN diagnostic_assessment a ON a.id = x.diagnostic_assessment_id
    JOIN diagnostic_assessment_type_hypothesis h ON h.id = x.hypothesis_id
)"""),
    "class_improvement_total": ((_T, _C, _S, _DAS, _DH), f"""
spans AS (
    SELECT student_id, max(ordering) > min(ordering) AS up
    FROM diagnostic_assessment_students x JOIN diagnostic_assessment_type_hypothesis h ON h.id = x.hypothesis_id
    GROUP BY student_id
),
report AS (
    SELECT k.id AS turma_id, k.name AS nome_turma, k.teacher_id AS professor_id,
           count(DISTINCT s.id) AS total_alunos,
           count(DISTINCT s.id) FILTER (WHERE up) AS alunos_com_melhoria,
           {_percent("count(DISTINCT s.id) FILTER (WHERE up)", "count(DISTINCT s.id)")} AS porcentagem_melhoria
    FROM class k JOIN teacher t ON t.id = k.teacher_id
    JOIN student s ON s.class_id = k.id LEFT JOIN spans ON spans.student_id = s.id
    GROUP BY ALL
    HAVING count(DISTINCT s.id) FILTER (WHERE up) > 0
)"""),
    "questionnaire_answers": ((_T, *_Q), f"""
answers AS (
    SELECT t.id AS tid, t.auth_id, q.label, a.value, r.created_at, y.name AS kind,
           count(a.id) OVER (PARTITION BY t.id) AS n
    FROM questionnaire_answer a, questionnaire_question q, questionnaire_response r,
         questionnaire f, questionnaire_type y, teacher t
    WHERE q.id = a.question_id AND r.id = a.response_id AND f.id = r.questionnaire_id
      AND y.id = f.type_id AND t.id = r.teacher_id
),
report AS (
    SELECT tid AS id_professor, auth_id AS id_nova_escola, label AS pergunta, value AS resposta,
           created_at AS data_resposta, if(n < 3, '{ANSWERED_PARTLY}', '{ANSWERED_ALL}') AS status_resposta
    FROM answers WHERE kind = 'Onboarding' AND auth_id NOT IN {_OUT}
)"""),
    "teacher_class_student": ((_T, _C, _S, _SC), _ROSTER),
    "registered_classes": ((_T, _C, _S, _SC), _ROSTER.replace("report AS", "roster AS", 1) + """,
report AS (
    SELECT * EXCLUDE (flag_onboarding, flag_turma) FROM roster
    WHERE id_turma IS NOT NULL AND id_aluno IS NOT NULL AND estado_escola IS NOT NULL
)"""),
    "class_improvement_by_month": ((_T, _C, _S, _SC, _DA, _DAS, _DH), _by_month(
        "SELECT class_id AS cid, count(DISTINCT id) AS n FROM student GROUP BY class_id")),
    "class_improvement_by_month_assessed": ((_T, _C, _S, _SC, _DA, _DAS, _DH), _by_month(
        "SELECT cid, count(DISTINCT sid) AS n FROM levels WHERE lvl > 1 GROUP BY cid")),
}


def on(report: str, select: str, views: bool = True) -> str:
    """A query over the rows of a report, named ``report`` in ``select``.

    Without ``views`` the twelve tables are taken as they are.
    """
    tables, ctes = REPORTS[report]
    return f"{sample_ctes(*tables)},{ctes}\n{select}" if views else f"WITH {ctes}\n{select}"


def over(*tables: str, select: str) -> str:
    """A query over the tables themselves."""
    return f"{sample_ctes(*tables)}\n{select}"


_FIRST_SEEN = """(
    SELECT estado_escola AS uf,
           row_number() OVER (ORDER BY min((coalesce(id_professor, -1), coalesce(id_turma, -1), coalesce(id_aluno, -1)))) - 1 AS ordem
    FROM report WHERE estado_escola IS NOT NULL GROUP BY estado_escola)"""

_IMPROVEMENT_KPIS = """
SELECT count(DISTINCT id_professor) AS total_professores, count(DISTINCT id_turma) AS total_turmas,
       CAST(sum(total_alunos) AS BIGINT) AS soma_alunos, CAST(sum(alunos_com_melhoria) AS BIGINT) AS alunos_evid,
       count(DISTINCT id_professor) FILTER (WHERE porcentagem_melhoria >= 50) AS total_professores_50
FROM report"""

_CHANGED = """
SELECT student_id FROM diagnostic_assessment_students x
JOIN diagnostic_assessment_type_hypothesis h ON h.id = x.hypothesis_id
GROUP BY student_id HAVING count(DISTINCT ordering) > 1"""

_THREE = "SELECT count(DISTINCT {}) AS total_professores, count(DISTINCT {}) AS total_turmas, count(DISTINCT {}) AS total_alunos FROM report"

# column, kind by type
_PROFILED = (
    ("id_professor", "numeric"), ("id_nova_escola", "text"), ("confirmado", "numeric"), ("ativo", "numeric"),
    ("data_criacao", "datetime"), ("data_atualizacao", "datetime"), ("onboarding_completo", "numeric"),
)
_ROSTER_PROFILED = (
    ("id_professor", "numeric"), ("id_nova_escola", "text"), ("data_cadastro_professor", "datetime"),
    ("flag_onboarding", "text"), ("flag_turma", "text"), ("id_turma", "numeric"), ("nome_turma", "text"),
    ("ano_turma", "numeric"), ("data_cadastro_turma", "datetime"), ("id_aluno", "numeric"), ("nome_aluno", "text"),
    ("nome_escola", "text"), ("cidade_escola", "text"), ("estado_escola", "text"), ("data_cadastro_aluno", "datetime"),
)


def _profile(columns: tuple[tuple[str, str], ...], exact: bool) -> str:
    def one(column: str, kind: str) -> str:
        few = f"count(DISTINCT {column}) < 10"
        n = f"count(DISTINCT {column})"
        step = f"(CAST(max({column}) AS DOUBLE) - CAST(min({column}) AS DOUBLE)) / 100" if kind == "numeric" else "NULL"
        return f"""
SELECT '{column}' AS "column", if({few}, 'categorical', '{kind}') AS kind,
       {n if exact else f"if({few}, {n}, NULL)"} AS n_distinct,
       CAST(min({column}) AS VARCHAR) AS "min", CAST(max({column}) AS VARCHAR) AS "max",
       CAST(if({few}, NULL, {step}) AS DOUBLE) AS step,
       if({few}, array_to_string(list_sort(list(DISTINCT CAST({column} AS VARCHAR))), ' | '), NULL) AS "values",
       count(*) > count({column}) AS has_null
FROM report"""
    return " UNION ALL ".join(one(*c) for c in columns)


# The chain of filters of the registry, as conditions.
_CHAIN = (
    ("flag_turma", "text", "flag_turma = 'Tem Turma'"),
    ("ano_turma", "numeric", "ano_turma BETWEEN 1995 AND 1997"),
    ("data_cadastro_professor", "datetime",
     "data_cadastro_professor BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'"),
    ("estado_escola", "text", "regexp_matches(estado_escola, '^NATION_[1-9]$')"),
)


def _facets() -> str:
    """Each filter's column on the rows that the filters before it keep."""
    found = []
    for i, (column, kind, _) in enumerate(_CHAIN):
        before = " AND ".join(condition for *_, condition in _CHAIN[:i]) or "true"
        profile = _profile(((column, kind),), exact=False).replace("FROM report", f"FROM report WHERE {before}")
        found.append(f"""
SELECT CAST({i + 1} AS INTEGER) AS place, p.*, (SELECT count(*) FROM report WHERE {before}) AS "rows" FROM ({profile}) p""")
    return " UNION ALL ".join(found)


def _series(points: dict[str, str], measures: str) -> str:
    """``measures`` in total and per point of each series."""
    parts = [f"SELECT 'total' AS serie, CAST(NULL AS VARCHAR) AS chave, {measures} FROM report"]
    parts += [
        f"SELECT '{name}' AS serie, CAST({key} AS VARCHAR) AS chave, {measures} FROM report WHERE {key} IS NOT NULL GROUP BY {key}"
        for name, key in points.items()
    ]
    return " UNION ALL ".join(parts)


def oracle_queries() -> dict[str, str]:
    sql = {name: on(name, "SELECT * FROM report") for name in REPORTS}

    # totals and level changes
    sql["onboardings_total"] = over(_T, select=f"""
SELECT count(*) AS total_onboardings FROM teacher WHERE onboarding_completed = 1 AND auth_id NOT IN {_OUT}""")
    sql["students_total"] = over(_S, select="SELECT count(DISTINCT id) AS total_students FROM student WHERE active = 1")
    sql["diagnostics_total"] = over(_DA, select="SELECT count(DISTINCT id) AS total_diagnosis FROM diagnostic_assessment")
    sql["classes_total"] = over(_C, select="SELECT count(DISTINCT id) AS total_classes FROM class")
    sql["evolved_students_count"] = over(_DAS, _DH, select=f"""
SELECT count(*) AS total_students_with_evolution
FROM ({_CHANGED} AND count(DISTINCT created_at) > 1)""")
    known_changed = f"FROM ({_CHANGED}) WHERE student_id IN (SELECT id FROM student)"
    sql["evolved_students_distinct"] = over(_S, _DAS, _DH, select=f"""
SELECT CAST(1 AS BIGINT) AS total_alunos_distintos_com_evolucao {known_changed}""")
    sql["evolved_students_n"] = over(_S, _DAS, _DH, select=f"""
SELECT count(*) AS total_students_with_evolution {known_changed}""")
    multi = """FROM (SELECT t.id FROM teacher t JOIN class k ON k.teacher_id = t.id GROUP BY t.id HAVING count(*) >= 2)"""
    sql["teachers_multi_class"] = over(_T, _C, select=f"SELECT CAST(1 AS BIGINT) AS total_teachers_with_multiple_classes {multi}")
    sql["teachers_multi_class_n"] = over(_T, _C, select=f"SELECT count(*) AS total_profs_mais {multi}")
    repeated = "FROM (SELECT count(DISTINCT class_id) AS one FROM diagnostic_assessment GROUP BY class_id HAVING count(*) >= 2)"
    sql["classes_multi_assessment"] = over(_DA, select=f"SELECT one AS total_classes_with_multiple_assessments {repeated}")
    sql["classes_multi_assessment_n"] = over(_DA, select=f"""
SELECT CAST(coalesce(sum(one), 0) AS BIGINT) AS total_turmas, count(*) AS total_turmas_mais {repeated}""")

    # logins
    sql["login_kpis"] = on("logins", """
SELECT count(DISTINCT id_professor) AS total_logins,
       count(DISTINCT CASE WHEN onboarding_completo = 1 THEN id_professor END) AS total_onboardings FROM report""")
    per_day = """SELECT CAST({0} AS DATE) AS {0}, count(DISTINCT id_professor) AS total_professores
FROM report {1} GROUP BY 1"""
    sql["logins_per_day"] = on("logins", per_day.format("data_criacao", ""))
    sql["onboardings_per_day"] = on("logins", per_day.format("data_criacao", "WHERE onboarding_completo = 1"))
    sql["onboarded_teachers"] = on("logins", "SELECT * FROM report WHERE onboarding_completo = 1")

    # questionnaire
    sql["answered_all"] = on("questionnaire_answers", f"SELECT * FROM report WHERE status_resposta = '{ANSWERED_ALL}'")
    sql["answered_partly"] = on("questionnaire_answers", f"SELECT * FROM report WHERE status_resposta = '{ANSWERED_PARTLY}'")
    sql["questionnaire_kpis"] = on("questionnaire_answers", f"""
SELECT count(DISTINCT id_professor) FILTER (WHERE status_resposta = '{ANSWERED_ALL}') AS total_professores,
       count(DISTINCT id_professor) FILTER (WHERE status_resposta = '{ANSWERED_PARTLY}') AS total_professores_n
FROM report""")
    summary = """SELECT status_resposta, pergunta, resposta, count(*) AS "count" {}
FROM report WHERE pergunta IS NOT NULL AND resposta IS NOT NULL {} GROUP BY ALL"""
    label = ", CASE resposta WHEN 'click' THEN 'cli<br>ck' WHEN 'purchase' THEN 'pur<br>chase' ELSE resposta END AS resposta_ajustada"
    sql["answer_summary"] = on("questionnaire_answers", summary.format("", ""))
    sql["answer_summary_recoded"] = on("questionnaire_answers", summary.format(label, ""))
    sql["question_series"] = on("questionnaire_answers", summary.format(label, "AND pergunta = 'Q3'"))

    # teachers, classes, students
    roster = "teacher_class_student"
    sql["teacher_kpis"] = on(roster, _THREE.format(*(f"nullif({c}, 0)" for c in ("id_professor", "id_turma", "id_aluno"))))
    sql["teachers_per_day"] = on(roster, per_day.format("data_cadastro_professor", ""))
    sql["registration_spread"] = on(roster, """
SELECT CAST(data_cadastro_professor AS DATE) AS data_cadastro_professor,
       (epoch_us(max(data_cadastro_professor)) - epoch_us(min(data_cadastro_professor))) / CAST(6e7 AS DOUBLE) AS tempo_medio_cadastro
FROM report GROUP BY 1""")
    sql["state_order"] = on(roster, f"SELECT uf AS estado_escola, CAST(ordem AS INTEGER) AS ordem FROM {_FIRST_SEEN}")
    sql["teachers_by_state"] = on(roster, f"""
SELECT estado_escola, count(DISTINCT id_professor) AS total_professores, CAST(any_value(ordem) AS INTEGER) AS ordem
FROM report JOIN {_FIRST_SEEN} ON uf = estado_escola GROUP BY estado_escola""")
    sql["classes_by_state"] = on(roster, f"""
SELECT coalesce(estado_escola, '{UNKNOWN_STATE}') AS estado_escola, count(DISTINCT id_turma) AS total_turmas,
       CAST(coalesce(any_value(ordem), (SELECT count(DISTINCT estado_escola) FROM report)) AS INTEGER) AS ordem
FROM report LEFT JOIN {_FIRST_SEEN} ON uf = estado_escola GROUP BY report.estado_escola""")
    sql["classes_by_state_total"] = on(roster, """
SELECT CAST(sum(n) AS BIGINT) AS total_turmas
FROM (SELECT count(DISTINCT id_turma) AS n FROM report GROUP BY estado_escola)""")
    done = f"count(DISTINCT id_professor) FILTER (WHERE flag_onboarding = '{ONBOARDING_DONE}')"
    total = "count(DISTINCT id_professor)"
    sql["onboarding_rate"] = on(roster, f"""
SELECT {total} AS total_professores, {done} AS professores_onboarding_completo,
       {done} / {total} * 100 AS taxa_onboarding_completo, {total} - {done} AS professores_onboarding_incompleto
FROM report""")
    chosen = "FROM report WHERE estado_escola IN ('NATION_1', 'NATION_2')"
    sql["teachers_by_state_filtered"] = on(roster, f"""
SELECT estado_escola, count(DISTINCT id_professor) AS total_professores, CAST(any_value(ordem) AS INTEGER) AS ordem
FROM report JOIN {_FIRST_SEEN} ON uf = estado_escola
WHERE estado_escola IN ('NATION_1', 'NATION_2') GROUP BY estado_escola""")
    sql["classes_by_state_filtered"] = on(roster, f"""
SELECT coalesce(estado_escola, '{UNKNOWN_STATE}') AS estado_escola, count(DISTINCT id_turma) AS total_turmas,
       CAST(coalesce(any_value(ordem), (SELECT count(DISTINCT estado_escola) FROM report)) AS INTEGER) AS ordem
FROM report LEFT JOIN {_FIRST_SEEN} ON uf = estado_escola
WHERE estado_escola IN ('NATION_1', 'NATION_2') OR estado_escola IS NULL GROUP BY report.estado_escola""")
    sql["state_choices"] = on(roster, f"""
SELECT '{ALL_STATES}' AS estado_escola, CAST(0 AS INTEGER) AS ordem
UNION ALL SELECT uf, CAST(ordem + 1 AS INTEGER) FROM {_FIRST_SEEN}
UNION ALL SELECT DISTINCT estado_escola, CAST((SELECT count(DISTINCT estado_escola) + 1 FROM report) AS INTEGER)
FROM report WHERE estado_escola IS NULL""")
    sql["key_violations"] = over(*KEYS, select=" UNION ALL ".join(f"""
SELECT '{name}' AS "table", '{key}' AS "key", count(*) FILTER (WHERE k IS NOT NULL AND n > 1) AS repeated_keys,
       CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS rows_without_key
FROM (SELECT {key} AS k, count(*) AS n FROM {name} GROUP BY {key})""" for name, key in KEYS.items()))
    sql["state_filtered"] = on(roster, f"SELECT * {chosen}")
    sql["state_filtered_kpis"] = on(roster, f"""
SELECT count(DISTINCT id_professor) AS total_professores, count(DISTINCT id_turma) AS total_turmas,
       count(DISTINCT nullif(id_aluno, 0)) AS total_alunos {chosen}""")
    sql["class_kpis"] = on("registered_classes", _THREE.format("id_professor", "id_turma", "id_aluno"))
    sql["class_teachers_per_day"] = on("registered_classes", per_day.format("data_cadastro_professor", ""))
    sql["student_class_kpis"] = on("students_by_class", """
SELECT count(DISTINCT id_aluno) AS total_alunos, count(DISTINCT id_turma) AS total_turmas,
       count(DISTINCT cod_inep) AS total_escolas FROM report""")
    sql["first_hypothesis_counts"] = on("students_by_class", """
SELECT nome_hipotese, count(*) AS "count"
FROM (SELECT nome_hipotese FROM report WHERE nome_hipotese IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY id_aluno
                                 ORDER BY data_criacao_avaliacao DESC, id_avaliacao DESC, hipotese DESC) = 1)
GROUP BY nome_hipotese""")
    sql["ids_as_text"] = on("students_by_class", """
SELECT * REPLACE (CAST(id_professor AS VARCHAR) AS id_professor, CAST(id_turma AS VARCHAR) AS id_turma,
                  CAST(ano_turma AS VARCHAR) AS ano_turma, CAST(id_aluno AS VARCHAR) AS id_aluno,
                  CAST(cod_inep AS VARCHAR) AS cod_inep, CAST(id_avaliacao AS VARCHAR) AS id_avaliacao)
FROM report""")

    # display order, counts that add up, all series
    place = "SELECT *, row_number() OVER (ORDER BY {}) AS pos FROM report"
    sql["roster_sorted"] = on(roster, place.format("id_professor NULLS FIRST, id_turma NULLS FIRST, id_aluno NULLS FIRST"))
    sql["history_sorted"] = on("hypothesis_history", place.format("student_id, rn"))
    sql["pairing_sorted"] = on("students_by_class", place.format(
        "data_criacao_avaliacao DESC NULLS LAST, id_avaliacao, id_aluno, hipotese"))
    sql["teachers_per_month"] = on(roster, """
SELECT CAST(date_trunc('month', data_cadastro_professor) AS DATE) AS mes, count(DISTINCT id_professor) AS total_professores
FROM report GROUP BY 1""")
    sql["classes_by_state_rolled"] = on(roster, """
SELECT estado_escola, count(DISTINCT id_turma) AS total_turmas FROM report WHERE id_turma IS NOT NULL GROUP BY estado_escola""")
    sql["students_rolled"] = on(roster, "SELECT count(DISTINCT id_aluno) AS total_alunos FROM report")
    sql["roster_series"] = on(roster, _series(
        {"por_dia": "CAST(data_cadastro_professor AS DATE)", "por_estado": "estado_escola"},
        "count(DISTINCT id_professor) AS total_professores, count(DISTINCT id_turma) AS total_turmas, "
        "count(DISTINCT id_aluno) AS total_alunos"))
    sql["improvement_series"] = on("class_improvement_by_month", _series(
        {"por_mes": "mes_sondagem", "por_estado": "estado_escola"},
        "count(*) AS total_sondagens, count(DISTINCT id_professor) AS total_professores, "
        "count(DISTINCT id_turma) AS total_turmas, CAST(coalesce(sum(total_alunos), 0) AS BIGINT) AS soma_alunos, "
        "CAST(coalesce(sum(alunos_com_melhoria), 0) AS BIGINT) AS alunos_evid, "
        "CAST(sum(CAST(porcentagem_melhoria AS DECIMAL(18, 2))) AS DOUBLE) / count(porcentagem_melhoria) AS porcentagem_melhoria"))

    # improvement
    month = "class_improvement_by_month"
    sql["improvement_kpis"] = on(month, _IMPROVEMENT_KPIS)
    sql["improvement_kpis_assessed"] = on(f"{month}_assessed", _IMPROVEMENT_KPIS)
    grouped = "SELECT {0}, {1} FROM report WHERE {0} IS NOT NULL GROUP BY {0}"
    sql["rows_by_month"] = on(month, grouped.format("mes_sondagem", "count(*) AS total_sondagens"))
    sql["teachers_by_month"] = on(month, grouped.format("mes_sondagem", "count(DISTINCT id_professor) AS total_professores"))
    sql["classes_by_month"] = on(month, grouped.format("mes_sondagem", "count(DISTINCT id_turma) AS total_turmas"))
    sql["improved_classes_by_state"] = on(month, grouped.format("estado_escola", "count(DISTINCT id_turma) AS total_turmas"))
    mean = "CAST(sum(CAST(porcentagem_melhoria AS DECIMAL(18, 2))) AS DOUBLE) / count(porcentagem_melhoria) AS porcentagem_melhoria"
    sql["mean_improvement_by_month"] = on(month, grouped.format("mes_sondagem", mean))
    sql["mean_improvement_by_state"] = on(month, grouped.format("estado_escola", mean))
    sql["top5_states"] = on(month, grouped.format("estado_escola", mean) + " ORDER BY 2 DESC, 1 LIMIT 5")
    sql["overall_improvement_rate"] = on("class_improvement_total", """
SELECT CAST(sum(total_alunos) AS BIGINT) AS total_alunos, CAST(sum(alunos_com_melhoria) AS BIGINT) AS total_melhorias,
       CAST(sum(alunos_com_melhoria) AS DOUBLE) / CAST(sum(total_alunos) AS DOUBLE) * 100 AS percentual_total_melhoria
FROM report""")

    # stored tables and results are the reports that they hold
    for stored, plain in (
        ("student_evolution_stored", "student_evolution"), ("class_improvement_total_stored", "class_improvement_total"),
        ("class_improvement_refreshed", "class_improvement_total"),
        ("class_improvement_by_month_refreshed", "class_improvement_by_month"), ("login_kpis_written", "login_kpis"),
    ):
        sql[stored] = sql[plain]

    # filters and type repairs
    sql["filter_profile"] = on(roster, _profile(_ROSTER_PROFILED, exact=False))
    sql["filter_profile_merged"] = sql["filter_profile"]
    sql["filter_profile_exact"] = on("logins", _profile(_PROFILED, exact=True))
    sql["filter_in"] = on(roster, """
SELECT * FROM report WHERE cidade_escola IN ('ASIA', 'EUROPE') OR cidade_escola IS NULL""")
    sql["filter_range_num"] = on("class_improvement_total", "SELECT * FROM report WHERE porcentagem_melhoria BETWEEN 25 AND 50")
    sql["filter_in_default"] = on("registered_classes", "SELECT * FROM report")
    sql["filter_range_num_open"] = on("class_improvement_total", "SELECT * FROM report WHERE porcentagem_melhoria >= 50")
    sql["filter_range_date"] = on("logins", """
SELECT * FROM report WHERE data_criacao BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""")
    sql["filter_text"] = on("registered_classes", "SELECT * FROM report WHERE regexp_matches(estado_escola, '_1[0-4]$')")
    sql["filter_facets"] = on(roster, _facets())
    sql["chained_filters"] = on(roster, """
SELECT * FROM report
WHERE flag_turma = 'Tem Turma' AND ano_turma BETWEEN 1995 AND 1997
  AND data_cadastro_professor >= TIMESTAMP '2024-01-05 00:00:00'
  AND data_cadastro_professor <= TIMESTAMP '2024-01-15 00:00:00'
  AND regexp_matches(estado_escola, '^NATION_[1-9]$')""")
    whole = """SELECT turma_id, professor_id, CAST(total_alunos AS BIGINT) AS total_alunos,
       CAST(alunos_com_melhoria AS BIGINT) AS alunos_com_melhoria, porcentagem_melhoria {} FROM report"""
    sql["normalize_ints"] = on("class_improvement_total", whole.format(""))
    sql["format_integers"] = on("students_by_class", """
SELECT * REPLACE (CAST(ano_turma AS BIGINT) AS ano_turma, CAST(cod_inep AS BIGINT) AS cod_inep) FROM report""")
    sql["fill_null_numeric"] = on(roster, """
SELECT * REPLACE (coalesce(id_turma, 0) AS id_turma, coalesce(ano_turma, 0) AS ano_turma, coalesce(id_aluno, 0) AS id_aluno)
FROM report""")
    sql["infer_dates"] = on("class_improvement_by_month", """
SELECT id_turma, id_professor, nome_turma, make_timestamp(ano_turma, list_position({0}, mes_sondagem), 1, 0, 0, 0) AS mes
FROM report""".format(_MONTHS))
    sql["strip_tz"] = on("logins", "SELECT id_professor, data_criacao FROM report")
    return sql
