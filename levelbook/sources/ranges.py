"""Partitioned JDBC reads at key ranges of equal size.

Spark's own split cuts a key's values evenly, so gaps and dense stretches of ids make uneven
tasks. A histogram of the key, counted by the database, gives ranges that hold about equally many rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class KeyRanges:
    """How to read one table: ``partitions`` ranges of ``column``, a whole number, cut from a
    histogram with steps of ``width``."""

    column: str
    width: int
    partitions: int

    def histogram_query(self, table: str) -> str:
        """SQL for the database: one row per step that occurs, at most (range of the key / ``width``) rows."""
        step = f"floor({self.column} / {self.width})"
        return f"SELECT {step} AS step, count(*) AS n FROM {table} WHERE {self.column} IS NOT NULL GROUP BY {step}"

    def predicates(self, histogram: Iterable[tuple[int, int]]) -> list[str]:
        """Conditions that every row meets exactly one of, with about equally many rows each.

        ``histogram`` has the rows of :meth:`histogram_query`. Rows that came after it fall in the
        outer ranges, which are open; a NULL key falls in the first one. A step is never cut, so one
        that is larger than a share stands alone.
        """
        steps = sorted((int(step), int(n)) for step, n in histogram)
        share = sum(n for _, n in steps) / self.partitions
        cuts, taken = [], 0.0
        for (step, n), (after, _) in zip(steps, steps[1:], strict=False):
            taken += n
            if taken >= share * (len(cuts) + 1) and len(cuts) < self.partitions - 1:
                cuts.append(after * self.width)
                taken = max(taken, share * len(cuts))
        if not cuts:
            return ["1 = 1"]
        c = self.column
        between = [f"{c} >= {lo} AND {c} < {hi}" for lo, hi in zip(cuts, cuts[1:], strict=False)]
        return [f"{c} < {cuts[0]} OR {c} IS NULL", *between, f"{c} >= {cuts[-1]}"]


def read_by_ranges(spark: SparkSession, options: Mapping[str, str], table: str, ranges: KeyRanges) -> DataFrame:
    """The table with one task per range. The histogram is a query of the database; its few rows go to the driver."""
    counted = spark.read.format("jdbc").options(**options).option("query", ranges.histogram_query(table)).load()
    predicates = ranges.predicates((row[0], row[1]) for row in counted.collect())
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=predicates, properties=rest)
