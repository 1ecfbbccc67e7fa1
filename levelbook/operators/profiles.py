"""Column profiles that merge: one small row per load, from which the profile of all loads follows.

A report that grows by loads need not be read again to tell which filter each column takes. Per load
and column the least and greatest value, whether NULL occurs, the values while they are few, and a
sketch of the distinct values are kept. All of them merge, so a profile reads these rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelbook.operators.filters import CATEGORICAL, NUMERIC, _measures, _plain_kind

# The sketch has 2^12 registers: a standard error of about 1.6 % in about 2 KB.
SKETCH_BITS = 12


def load_profile(df: DataFrame, max_values: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """One row that describes ``df``: per column ``min``, ``max``, ``has_null``, ``sketch`` and ``values``, which
    is NULL where there are ``max_values`` or more. One lazy aggregate in constant memory."""
    names = list(columns or df.columns)
    measures, kept = [], []
    for c in names:
        found = _measures(df, c, max_values) | {
            "least": F.min(F.col(c)), "most": F.max(F.col(c)),
            "sketch": F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS),
        }
        measures += [found[m].alias(f"{c}|{m}") for m in ("estimate", "items", "least", "most", "has_null", "sketch")]

        def own(name: str) -> Column:
            return F.col(f"`{c}|{name}`")

        values = F.filter(F.transform(own("items"), lambda item: item["item"]), lambda value: value.isNotNull())
        few = (own("estimate") <= 2 * max_values) & (F.size(values) < max_values)
        kept += [
            own("least").alias(f"{c}|min"), own("most").alias(f"{c}|max"), own("has_null"), own("sketch"),
            F.when(few, values).alias(f"{c}|values"),
        ]
    return df.agg(*measures).select(*kept)


def merged_profile(loads: DataFrame, max_values: int = 10) -> DataFrame:
    """The profile of the union of all loads, from their rows of :func:`load_profile`.

    The columns are those of :func:`~levelbook.operators.filters.profile_columns`, and ``n_estimated``, the sketched
    number of distinct values. ``max_values`` must not be above that of the loads. Work and memory follow
    the number of loads, at most ``max_values`` values each.
    """
    names = [c.removesuffix("|min") for c in loads.columns if c.endswith("|min")]
    typed = loads.select(*[F.col(f"`{c}|min`").alias(c) for c in names])
    measures, described = [], []
    for c in names:
        def own(name: str) -> Column:
            return F.col(f"`{c}|{name}`")

        measures += [
            F.min(own("min")).alias(f"{c}|min"), F.max(own("max")).alias(f"{c}|max"),
            F.coalesce(F.bool_or(own("has_null")), F.lit(False)).alias(f"{c}|has_null"),
            F.hll_sketch_estimate(F.hll_union_agg(own("sketch"))).alias(f"{c}|estimated"),
            F.bool_and(own("values").isNotNull()).alias(f"{c}|few"),
            F.array_distinct(F.flatten(F.collect_list(own("values")))).alias(f"{c}|values"),
        ]
        kind = _plain_kind(typed, c)
        few = own("few") & (F.size(own("values")) < max_values)
        step = (own("max").cast("double") - own("min").cast("double")) / 100 if kind == NUMERIC else F.lit(None)
        described.append(F.struct(
            F.lit(c).alias("column"),
            F.when(few, CATEGORICAL).otherwise(kind).alias("kind"),
            F.when(few, F.size(own("values"))).cast("long").alias("n_distinct"),
            own("min").cast("string").alias("min"),
            own("max").cast("string").alias("max"),
            F.when(~few, step).cast("double").alias("step"),
            F.when(few, F.array_sort(own("values"))).cast("array<string>").alias("values"),
            own("has_null").alias("has_null"),
            F.coalesce(own("estimated"), F.lit(0)).cast("long").alias("n_estimated"),
        ))
    return loads.agg(*measures).select(F.inline(F.array(*described)))


class ProfileStore:
    """Profiles of the loads of a report in a folder, a row per load."""

    def __init__(self, spark: SparkSession, path: str, max_values: int = 10):
        self._spark, self._path, self._max_values = spark, path, max_values

    def add(self, df: DataFrame, load: str) -> None:
        """Keep the profile of a load, which is all that is read. The same load again takes the place of the old one."""
        folder = f"{self._path}/load={quote(load, safe='')}"
        load_profile(df, self._max_values).write.mode("overwrite").parquet(folder)

    def profile(self) -> DataFrame:
        """The profile of all loads together; there must be one."""
        return merged_profile(self._spark.read.parquet(self._path).drop("load"), self._max_values)
