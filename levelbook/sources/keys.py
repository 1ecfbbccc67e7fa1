"""Whether tables keep what :data:`levelbook.sources.schemas.KEYS` promises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.sources.schemas import KEYS
from levelbook.sources.tables import TableSet


def check_keys(tables: TableSet) -> DataFrame:
    """One row per table: ``table``, ``key``, how many key values are stored more than once, and how
    many rows have none. All zero is what the plans rely on. Run it once per load of the tables.

    Repeated ids count a teacher, student, class or assessment more than once in the totals and
    rosters, and multiply joined rows; rows without an id are left out of counts.
    """
    def one(name: str, key: str) -> DataFrame:
        rows = tables.table(name).groupBy(F.col(key).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return rows.agg(
            F.count_if(F.col("value").isNotNull() & (F.col("n") > 1)).alias("repeated_keys"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("rows_without_key"),
        ).select(F.lit(name).alias("table"), F.lit(key).alias("key"), "repeated_keys", "rows_without_key")

    return reduce(DataFrame.unionByName, [one(name, key) for name, key in KEYS.items()])
