"""All chart series and key figures of a report in one pass over it.

Every chart on its own would compute the report again. Here the report's rows are first combined
on the map side into one row per teacher, class and group, and these are counted under several
groupings at once. A series is told by its name, its points by their key as text. An empty report has
no points, not even a total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES, KEY = "serie", "chave"
TOTAL, PER_DAY, PER_STATE, PER_MONTH = "total", "por_dia", "por_estado", "por_mes"


def _several(rows: DataFrame, groups: dict[str, str], *measures: Column) -> DataFrame:
    """``measures`` in total and per column of ``groups`` (series name to column), points with a NULL
    key left out."""
    sets = [[], *([column] for column in groups.values())]
    counted = rows.groupingSets(sets, *groups.values()).agg(
        *[F.grouping(column).alias(f"_{column}") for column in groups.values()], *measures
    )
    series, key = F.lit(TOTAL), F.lit(None).cast("string")
    for name, column in groups.items():
        own = F.col(f"_{column}") == 0
        series = F.when(own, F.lit(name)).otherwise(series)
        key = F.when(own, F.col(column).cast("string")).otherwise(key)
    found = counted.withColumns({SERIES: series, KEY: key})
    kept = found.filter((F.col(SERIES) == TOTAL) | F.col(KEY).isNotNull())
    return kept.select(SERIES, KEY, *[c for c in counted.columns if c not in (*groups.values(), *(f"_{g}" for g in groups.values()))])


def roster_series(rows: DataFrame) -> DataFrame:
    """Distinct teachers, classes and students of the roster, in total, per day of the teacher's
    registration and per state. A student stands in one class, so students add up."""
    per_class = rows.groupBy(
        F.to_date("data_cadastro_professor").alias("_dia"), "estado_escola", "id_professor", "id_turma"
    ).agg(F.count("id_aluno").alias("_alunos"))
    return _several(
        per_class,
        {PER_DAY: "_dia", PER_STATE: "estado_escola"},
        F.count_distinct("id_professor").alias("total_professores"),
        F.count_distinct("id_turma").alias("total_turmas"),
        F.coalesce(F.sum("_alunos"), F.lit(0)).alias("total_alunos"),
    )


def improvement_series(rows: DataFrame) -> DataFrame:
    """Rows, distinct teachers and classes, students, improved students and the exact mean
    percentage of the improvement by month, in total, per month and per state."""
    rate = F.col("porcentagem_melhoria").cast("decimal(18,2)")  # a percentage of two digits
    per_class = rows.groupBy("mes_sondagem", "estado_escola", "id_professor", "id_turma").agg(
        F.count(F.lit(1)).alias("_linhas"), F.sum("total_alunos").alias("_alunos"),
        F.sum("alunos_com_melhoria").alias("_melhoria"), F.sum(rate).alias("_soma"), F.count(rate).alias("_n"),
    )
    mean = F.try_divide(F.sum("_soma").cast("double"), F.sum("_n").cast("double"))
    return _several(
        per_class,
        {PER_MONTH: "mes_sondagem", PER_STATE: "estado_escola"},
        F.coalesce(F.sum("_linhas"), F.lit(0)).alias("total_sondagens"),
        F.count_distinct("id_professor").alias("total_professores"),
        F.count_distinct("id_turma").alias("total_turmas"),
        F.coalesce(F.sum("_alunos"), F.lit(0)).alias("soma_alunos"),
        F.coalesce(F.sum("_melhoria"), F.lit(0)).alias("alunos_evid"),
        mean.alias("porcentagem_melhoria"),
    )
