"""Counting, grouping and ranking blocks for key figures and chart series.

All of them are partial aggregates first, so what crosses the network is at most one row
per group and task. A distinct count is keyed by (group, value) while it removes copies,
so neither a dominant group nor a dominant value ends up in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, FloatType

from levelbook.functions.columns import minutes_between, relabel

Kpi = str | tuple[str, Column | None]


def count_distinct(df: DataFrame, col: str, where: Column | None = None, name: str = "total") -> DataFrame:
    """One row: distinct non-null values of ``col`` among the rows where ``where`` holds."""
    kept = df if where is None else df.filter(where)
    return kept.agg(F.count_distinct(col).alias(name))


def distinct_kpis(df: DataFrame, kpis: Mapping[str, Kpi]) -> DataFrame:
    """Several distinct counts of one frame in one pass; each may have its own condition.

    Counts of one column under different conditions become one flag per condition and
    value. Counts of different columns copy each row once per column before the shuffle,
    which combines equal values on the map side.
    """
    parts = {name: (kpi, None) if isinstance(kpi, str) else kpi for name, kpi in kpis.items()}
    counted = {col for col, _ in parts.values()}
    if len(counted) == 1:
        col = counted.pop()
        met = [F.bool_or(F.lit(True) if where is None else where).alias(name) for name, (_, where) in parts.items()]
        flags = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value")).agg(*met)
        return flags.agg(*[F.count_if(name).alias(name) for name in parts])
    return df.agg(*[
        F.count_distinct(col if where is None else F.when(where, F.col(col))).alias(name)
        for name, (col, where) in parts.items()
    ])


def nested_kpis(df: DataFrame, levels: Mapping[str, str], where: Mapping[str, Column] | None = None,
                **measures: Column) -> DataFrame:
    """Distinct counts of keys that contain each other, outermost first, without copying rows.

    Every key belongs to one key of the level before (a student to one class, a class to one
    teacher), so a key is one row once the rows are grouped by the levels down to it: the
    innermost grouping shrinks the rows on the map side, the others see its result. ``levels``
    maps result names to columns; ``where`` says by level which keys count (non-null ones by
    default); ``measures`` are aggregates over the rows, summed up.
    """
    names = list(levels)
    columns = [levels[n] for n in names]
    counted = {n: F.coalesce((where or {}).get(n, F.col(levels[n]).isNotNull()), F.lit(False)) for n in names}
    rows = df.groupBy(*columns).agg(*[m.alias(f"_{n}") for n, m in measures.items()], F.lit(1).alias("_one"))
    sums = {f"_{n}": F.sum(f"_{n}") for n in measures}
    below: list[str] = []
    for i in range(len(names) - 1, 0, -1):
        own = F.count_if(counted[names[i]]).alias(f"_{names[i]}")
        rows = rows.groupBy(*columns[:i]).agg(own, *[F.sum(b).alias(b) for b in below], *[s.alias(n) for n, s in sums.items()])
        below.append(f"_{names[i]}")
    total = [F.count_if(counted[names[0]]).alias(names[0])]
    total += [F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(n) for n in names[1:]]
    total += [F.sum(f"_{n}").alias(n) for n in measures]
    return rows.agg(*total)


def groups_with_more_than(df: DataFrame, keys: Sequence[str], col: str, n: int) -> DataFrame:
    """The keys whose group holds more than ``n`` non-null values of ``col``."""
    return df.groupBy(*keys).agg(F.count(col).alias("n_values")).filter(F.col("n_values") > n).select(*keys)


def distinct_per(
    df: DataFrame,
    key: str,
    col: str,
    name: str = "total",
    keep_null: str | None = None,
    order: DataFrame | Sequence[str] | None = None,
) -> DataFrame:
    """Distinct values of ``col`` per ``key``.

    Rows with a NULL key are left out, unless ``keep_null`` gives the label they are
    counted under. With ``order`` the result also carries the key's rank by first
    appearance: taken from a ranking of other rows made by :func:`first_appearance_rank`,
    or, given sort keys with ``col`` among them, found on these rows in the same pass.
    """
    kept = df if keep_null is not None else df.filter(F.col(key).isNotNull())
    distinct = F.count_distinct(col).alias(name)
    if order is None:
        counted = kept.groupBy(key).agg(distinct)
    elif isinstance(order, DataFrame):
        rank = order.withColumnRenamed(key, "_ranked")
        same = F.col(key).eqNullSafe(F.col("_ranked"))
        counted = kept.groupBy(key).agg(distinct).join(rank, same, "left").drop("_ranked")
    elif col in order:
        counted = _ranked(_leading(kept, key, order), key, order, "ordem", distinct)
    else:
        raise ValueError(f"{col} must be one of the sort keys")
    return counted.fillna(keep_null, subset=[key]) if keep_null is not None else counted


def _leading(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per ``key`` and all sort keys but the last, with the smallest last one.

    Shrinks detail rows in a hash aggregate over plain columns; a minimum of structs over
    the detail rows would sort them all.
    """
    *leading, last = order
    smallest = F.when(F.bool_or(F.col(last).isNull()), None).otherwise(F.min(last))
    return df.groupBy(key, *leading).agg(smallest.alias(last))


def _ranked(df: DataFrame, key: str, order: Sequence[str], name: str, *measures: Column) -> DataFrame:
    """One row per ``key``, numbered from 0 by its smallest sort keys, NULL last.

    The numbering sees only the categories of ``key``, however many rows there are.
    """
    by_first = Window.orderBy(F.col(key).isNull(), F.col("_first"))
    firsts = df.groupBy(key).agg(*measures, F.min(F.struct(*order)).alias("_first"))
    return firsts.withColumn(name, F.row_number().over(by_first) - 1).drop("_first")


def per_day(df: DataFrame, ts: str, col: str, name: str = "total") -> DataFrame:
    """Distinct values of ``col`` per calendar day of ``ts``; the day keeps ``ts``'s name."""
    return distinct_per(df.select(F.to_date(ts).alias(ts), col), ts, col, name)


def rows_per(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """Rows per combination of ``keys``; combinations with a NULL are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def recode(df: DataFrame, col: str, labels: Mapping[str, str], into: str | None = None) -> DataFrame:
    """``col`` with exact values replaced by their labels, in place or ``into`` a new column."""
    return df.withColumn(into or col, relabel(F.col(col), labels))


def series_for(df: DataFrame, col: str, value: object) -> DataFrame:
    """The rows of one chart: those whose ``col`` equals ``value``."""
    return df.filter(F.col(col) == F.lit(value))


def mean_per(df: DataFrame, key: str, col: str) -> DataFrame:
    """Unweighted mean of ``col`` per non-null ``key``.

    Added as decimals, so the mean does not depend on the order of the rows: decimals and whole
    numbers at their own scale, doubles at 15 decimals, which leaves 13 digits for a whole sum.
    """
    kind = df.schema[col].dataType
    number = F.col(col).cast("decimal(28,15)") if isinstance(kind, (DoubleType, FloatType)) else F.col(col)
    exact = F.sum(number).cast("double")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.try_divide(exact, F.count(col).cast("double")).alias(col))


def spread_minutes(df: DataFrame, ts: str, name: str = "minutes") -> DataFrame:
    """Per calendar day of ``ts``: minutes between its first and its last moment."""
    day = F.to_date(ts).alias("_day")
    ends = df.filter(F.col(ts).isNotNull()).groupBy(day).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    return ends.select(F.col("_day").alias(ts), minutes_between(F.col("_first"), F.col("_last")).alias(name))


def top_k(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows with the largest ``col``; ties go to the smaller ``tie``."""
    return df.orderBy(F.col(col).desc(), F.col(tie).asc()).limit(k)


def first_appearance_rank(df: DataFrame, col: str, order_keys: Sequence[str], name: str = "ordem") -> DataFrame:
    """Categories of ``col`` numbered from 0 by where they first appear when ``df`` is sorted.

    ``df`` itself is never sorted. NULL, if present, comes last.
    """
    return _ranked(_leading(df, col, order_keys), col, order_keys, name)
