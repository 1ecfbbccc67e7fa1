"""Tables and results in storage of their own: bucketed copies, and figures taken while writing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from levelbook.sources.schemas import SCHEMAS
from levelbook.sources.tables import TableSet

# Both sides of the joins by student, told by the student's id.
BUCKETED = {"student": "id", "diagnostic_assessment_students": "student_id"}


def store_tables(tables: TableSet, spark: SparkSession, database: str, buckets: int = 64) -> TableSet:
    """Write all tables to ``database``, those of :data:`BUCKETED` bucketed and sorted by student.

    Levels then meet their students bucket by bucket, without a shuffle, in every report that
    reads the returned set; the shuffle is paid once, here. ``buckets`` is the number of tasks of
    these joins: a bucket should fit in a task.
    """
    for name in SCHEMAS:
        writer = tables.table(name)
        if name in BUCKETED:
            # One file per bucket, as equal keys are in one task.
            writer = writer.repartition(buckets, BUCKETED[name]).write.bucketBy(buckets, BUCKETED[name]).sortBy(BUCKETED[name])
        else:
            writer = writer.write
        writer.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
    return TableSet.from_catalog(spark, database)


def write_with_figures(df: DataFrame, path: str, figures: Mapping[str, Column]) -> dict[str, object]:
    """Write ``df`` as Parquet and return ``figures``, aggregates over its rows, from the same job.

    For aggregates without distinct; ids are counted plainly where they are keys.
    """
    seen = Observation("figures")
    df.observe(seen, *[measure.alias(name) for name, measure in figures.items()]).write.parquet(path)
    return dict(seen.get)
