"""The improvement of classes kept up to date: new level rows touch their students and classes only.

What the report needs of a student is small and can be merged: the lowest and highest level and the
month of the latest assessment. It is kept per student, in parts by the student's hash; the report
is kept in parts by the class's hash. New rows are reduced to their students, merged into the
parts that hold these, and the classes of these students are computed again from the stored
levels. All other parts stay as they are. Merging the same rows twice changes nothing, so a refresh that
broke off is repeated.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelbook.plans.improvement import class_improvement, level_state, merged_levels
from levelbook.plans.logins import Accounts
from levelbook.sources import TableSet
from levelbook.sources.staging import remove, staged_path

_PART = "parte"


class ImprovementStore:
    """The report of :func:`class_improvement` and the levels behind it, in a folder."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        by_month: bool = False,
        denominator: Literal["all", "assessed"] = "all",
        excluded: Accounts | None = None,
        parts: int = 64,
    ):
        self._spark, self._path, self._parts = spark, path, parts
        self._options = dict(by_month=by_month, denominator=denominator, excluded=excluded)
        self._class = "id_turma" if by_month else "turma_id"

    def _part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self._parts)).cast("int").alias(_PART)

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._path}/{name}")

    def _write(self, rows: DataFrame, name: str, key: str) -> None:
        """Replace the parts that ``rows`` holds. They may come from the stored parts, so they are set aside first."""
        aside = staged_path(self._spark, f"refresh-{name}")
        rows.withColumn(_PART, self._part(key)).repartition(_PART).write.parquet(aside)
        fresh = self._spark.read.parquet(aside)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(
            f"{self._path}/{name}"
        )
        remove(self._spark, aside)

    def _state(self, tables: TableSet, rows: DataFrame | None = None) -> DataFrame:
        return level_state(tables, rows, self._options["by_month"])

    def build(self, tables: TableSet) -> None:
        """Everything, from the whole tables."""
        self._write(self._state(tables), "levels", "student_id")
        self._write(class_improvement(tables, levels=self._read("levels").drop(_PART), **self._options), "report", self._class)

    def refresh(self, tables: TableSet, new_rows: DataFrame, new_students: DataFrame | None = None) -> None:
        """Take in ``new_rows`` of ``diagnostic_assessment_students`` and, for the sizes of their
        classes, ``new_students``. ``tables`` are the tables as they are now."""
        new = self._state(tables, new_rows).withColumn(_PART, self._part("student_id"))
        aside = staged_path(self._spark, "refresh-new")
        new.write.parquet(aside)
        new = self._spark.read.parquet(aside)
        # At most as many numbers as there are parts.
        parts = [r[0] for r in new.select(_PART).distinct().collect()]
        known = self._read("levels").filter(F.col(_PART).isin(parts))
        if parts:
            self._write(merged_levels(known.unionByName(new).drop(_PART)), "levels", "student_id")

        student = tables.table("student")
        changed = student.join(new.select(F.col("student_id").alias("id")).distinct(), "id", "left_semi").select("class_id")
        if new_students is not None:
            changed = changed.unionByName(new_students.select("class_id"))
        touched = changed.dropna().distinct().select(F.col("class_id").alias(self._class))
        classes = staged_path(self._spark, "refresh-classes")
        touched.withColumn(_PART, self._part(self._class)).write.parquet(classes)
        touched = self._spark.read.parquet(classes)
        parts = [r[0] for r in touched.select(_PART).distinct().collect()]
        if parts:
            again = class_improvement(
                tables, levels=self._read("levels").drop(_PART),
                classes_of=touched.select(F.col(self._class).alias("id_turma")), **self._options,
            )
            stay = self._read("report").filter(F.col(_PART).isin(parts)).join(touched.select(self._class), self._class, "left_anti")
            self._write(stay.drop(_PART).unionByName(again), "report", self._class)
        remove(self._spark, aside)
        remove(self._spark, classes)

    def report(self) -> DataFrame:
        return self._read("report").drop(_PART)
