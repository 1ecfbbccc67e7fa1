"""Who registered, and who finished the onboarding."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.operators.accounts import exclude_accounts
from levelbook.operators.counts import distinct_kpis, per_day
from levelbook.sources import TableSet

Accounts = Collection[str] | DataFrame


def logins(tables: TableSet, excluded: Accounts) -> DataFrame:
    """The registered teachers without the excluded accounts, one row each by the key of the table."""
    return exclude_accounts(tables.table("teacher"), excluded).select(
        F.col("id").alias("id_professor"),
        F.col("auth_id").alias("id_nova_escola"),
        F.col("confirmed").alias("confirmado"),
        F.col("active").alias("ativo"),
        F.col("created_at").alias("data_criacao"),
        F.col("updated_at").alias("data_atualizacao"),
        F.col("onboarding_completed").alias("onboarding_completo"),
    )


def onboardings_total(tables: TableSet, excluded: Accounts) -> DataFrame:
    """Teachers with a finished onboarding. Counts rows, and takes its own account list."""
    done = tables.table("teacher").filter(F.col("onboarding_completed") == 1)
    return exclude_accounts(done, excluded).agg(F.count("auth_id").alias("total_onboardings"))


# Ids are keys, so distinct ones are counted without a shuffle; see levelbook.sources.keys.

def students_total(tables: TableSet) -> DataFrame:
    return tables.table("student").filter(F.col("active") == 1).agg(F.count("id").alias("total_students"))


def diagnostics_total(tables: TableSet) -> DataFrame:
    return tables.table("diagnostic_assessment").agg(F.count("id").alias("total_diagnosis"))


def classes_total(tables: TableSet) -> DataFrame:
    return tables.table("class").agg(F.count("id").alias("total_classes"))


def onboarded_teachers(login_rows: DataFrame) -> DataFrame:
    return login_rows.filter(F.col("onboarding_completo") == 1)


def login_kpis(login_rows: DataFrame) -> DataFrame:
    done = F.col("onboarding_completo") == 1
    return distinct_kpis(
        login_rows, {"total_logins": "id_professor", "total_onboardings": ("id_professor", done)}
    )


def logins_per_day(login_rows: DataFrame) -> DataFrame:
    return per_day(login_rows, "data_criacao", "id_professor", "total_professores")


def onboardings_per_day(login_rows: DataFrame) -> DataFrame:
    return logins_per_day(onboarded_teachers(login_rows))
