"""Exact distinct counts that add up: one bitmap of ids per group, day and block of ids.

A distinct count per day says nothing of the distinct count per month. A bitmap does: bitmaps of
days are joined by OR, and the month's count is the number of bits, so months, states and totals are
rolled up from the stored days without the detail rows, and a new day is added without reading the
old ones. Bitmaps are built and joined on the map side; a block of ids is 32,768 of them, so a group with
very many ids is many small rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, BLOCK, BITS = "dia", "bloco", "bits"


def day_bitmaps(rows: DataFrame, ts: str, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, the day of ``ts``, a block number and the bitmap of the values of ``col`` in that block.

    ``col`` holds whole numbers; NULL is not counted. Keys and days may be NULL.
    """
    number = F.col(col).cast("long")
    known = rows.filter(F.col(col).isNotNull())
    return known.groupBy(*keys, F.to_date(ts).alias(DAY), F.bitmap_bucket_number(number).alias(BLOCK)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITS)
    )


def merged_bitmaps(bitmaps: DataFrame, groups: Sequence[Column | str]) -> DataFrame:
    """Bitmaps of coarser groups."""
    return bitmaps.groupBy(*groups, BLOCK).agg(F.bitmap_or_agg(BITS).alias(BITS))


def rolled_up(bitmaps: DataFrame, groups: Sequence[Column | str] = (), name: str = "total") -> DataFrame:
    """Distinct values per group: ``groups`` are keys of the bitmaps or columns made of them, such
    as the month of the day. Without groups, one row."""
    names = [g if isinstance(g, str) else f"_g{i}" for i, g in enumerate(groups)]
    merged = merged_bitmaps(bitmaps, [g if isinstance(g, str) else g.alias(n) for g, n in zip(groups, names, strict=True)])
    total = F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).alias(name)
    return merged.groupBy(*names).agg(total) if names else merged.agg(total)


class DailyCounts:
    """Bitmaps of days in a folder, a partition per day. Days are added or replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def add(self, bitmaps: DataFrame) -> None:
        """Write the days of ``bitmaps``; a day that is there already is replaced, the others stay."""
        in_days = bitmaps.repartition(F.col(DAY))
        in_days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self._path)

    def read(self) -> DataFrame:
        """Filters on the day reach the folders."""
        found = self._spark.read.parquet(self._path)
        return found.withColumn(DAY, F.col(DAY).cast("date"))
