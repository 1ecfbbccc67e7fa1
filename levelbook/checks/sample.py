"""The twelve tables as views over the general test tables.

The texts run in Spark SQL and in DuckDB. ``{name}`` stands for a test table. Every row of a test
table that a view reads becomes a row, or part of one, of the view; ids start at 1.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from levelbook.sources import TableSet, tuned

VIEWS: dict[str, str] = {
    "school": """
        SELECT n_nationkey AS cod_inep, 'Escola ' || n_name AS name, r_name AS municipio, n_name AS uf
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "teacher": """
        SELECT c_custkey + 1 AS id,
               CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE CAST(c_custkey AS STRING) END AS auth_id,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0 ELSE 1 END AS confirmed,
               CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1 END AS active,
               CASE WHEN c_acctbal > 3000 THEN 1 ELSE 0 END AS onboarding_completed,
               ts AS created_at, ts AS updated_at
        FROM {customer} LEFT JOIN {events} ON event_id = c_custkey * 6""",
    "class": """
        SELECT o_orderkey + 1 AS id, o_custkey + 1 + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS teacher_id,
               'Turma ' || o_orderpriority AS name,
               CAST(year(o_orderdate) AS INT) AS year,
               CASE WHEN o_orderkey % 27 = 26 THEN NULL ELSE CAST(o_orderkey % 27 AS INT) END AS cod_inep,
               o_orderdate AS created_at
        FROM {orders}""",
    "student": """
        SELECT l_orderkey * 8 + l_linenumber + 1 AS id,
               l_orderkey + 1 + CASE WHEN l_orderkey % 3 = 1 AND l_linenumber = 2 THEN 1000000000 ELSE 0 END AS class_id,
               'Aluno ' || CAST(l_orderkey * 8 + l_linenumber AS STRING) AS name,
               CASE WHEN (l_orderkey * 8 + l_linenumber) % 10 = 0 THEN 0 ELSE 1 END AS active,
               min(l_shipdate) AS created_at
        FROM {lineitem}
        GROUP BY l_orderkey, l_linenumber""",
    "diagnostic_assessment": """
        SELECT l_orderkey * 12 + month(l_shipdate) AS id, o_custkey + 1 AS teacher_id,
               l_orderkey + 1 + CASE WHEN l_orderkey % 3 = 2 AND month(l_shipdate) = 6 THEN 1000000000 ELSE 0 END AS class_id,
               CAST(month(l_shipdate) AS STRING) AS month,
               min(l_shipdate) AS created_at
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, o_custkey, month(l_shipdate)""",
    "diagnostic_assessment_students": """
        SELECT l_orderkey * 8 + l_linenumber + 1 AS student_id,
               l_orderkey * 12 + month(l_shipdate) AS diagnostic_assessment_id,
               CASE WHEN l_orderkey % 3 = 0 THEN 1 + CAST(l_orderkey % 5 AS INT)
                    ELSE 1 + CAST(l_quantity AS INT) % 5 END AS hypothesis_id,
               CASE WHEN l_linestatus = 'O' THEN 'obs ' || l_returnflag END AS comment,
               l_shipdate AS created_at
        FROM {lineitem}""",
    "diagnostic_assessment_type_hypothesis": """
        SELECT r_regionkey + 1 AS id, r_name AS name, 5 - r_regionkey AS ordering
        FROM {region}""",
    "questionnaire_type": "SELECT * FROM (VALUES (1, 'Onboarding'), (2, 'Outro')) AS v(id, name)",
    "questionnaire": "SELECT * FROM (VALUES (1, 1), (2, 2)) AS v(id, type_id)",
    "questionnaire_question": "SELECT * FROM (VALUES (1, 'Q1'), (2, 'Q2'), (3, 'Q3')) AS v(id, label)",
    "questionnaire_response": """
        SELECT {respondent} * 100 + dayofmonth(ts) AS id, {respondent} AS teacher_id,
               CASE WHEN dayofmonth(ts) % 4 = 0 THEN 2 ELSE 1 END AS questionnaire_id,
               min(ts) AS created_at
        FROM {events}
        GROUP BY {respondent}, dayofmonth(ts)""",
    "questionnaire_answer": """
        SELECT event_id + 1 AS id, {respondent} * 100 + dayofmonth(ts) AS response_id,
               CAST(1 + event_id % 3 AS INT) AS question_id, event_type AS value
        FROM {events}""",
}

# Who answers with an event: some teachers answer rarely, some respondents are no teachers.
RESPONDENT = "(1 + CAST(floor(event_id / (1 + event_id % 7)) AS BIGINT))"
VIEWS = {name: view.replace("{respondent}", RESPONDENT) for name, view in VIEWS.items()}

TEST_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
}

EXCLUDED = ("3", "6", "18", "64")


@lru_cache(maxsize=8)
def sample_tables(spark: SparkSession, sf_dir: str) -> TableSet:
    """The table set over one directory of test tables, opened once per session."""
    tuned(spark)

    def test_table(name: str) -> DataFrame:
        return spark.read.schema(TEST_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    def load(name: str) -> DataFrame:
        return spark.sql(VIEWS[name], **{t: test_table(t) for t in TEST_TABLES if f"{{{t}}}" in VIEWS[name]})

    return TableSet(load)


def sample_ctes(*names: str) -> str:
    """The same views as leading CTEs of a DuckDB query."""
    plain = {t: t for t in TEST_TABLES}
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name].format(**plain)})" for name in names)
