"""The interactive filter: profile the columns of a result, then filter by chosen values.

Filters are ordinary predicates on the lazy plan, so the optimizer moves them below the
joins of the report and into the scan.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from levelbook.functions.vocabulary import ALL_STATES

CATEGORICAL, NUMERIC, DATETIME, TEXT = "categorical", "numeric", "datetime", "text"


@dataclass(frozen=True)
class FilterSpec:
    """One choice of the user for one column.

    ``categorical`` uses ``values`` (None in them stands for NULL), ``numeric`` and
    ``datetime`` use ``lo`` and ``hi``, ``text`` uses the regular expression ``pattern``.
    A filter starts from everything: ``values=None``, no bound and no pattern keep all rows.
    """

    column: str
    kind: str
    values: Collection[object] | None = None
    lo: object = None
    hi: object = None
    pattern: str = ""
    whole_day: bool = False


def _in(column: str, values: Collection[object] | None) -> Column | None:
    if values is None:
        return None
    present = [v for v in values if v is not None and v == v]
    chosen = F.col(column).isin(present) if present else F.lit(False)
    return chosen | F.col(column).isNull() if len(present) < len(values) else chosen


def _range(column: str, lo: object, hi: object) -> Column | None:
    bounds = [F.col(column) >= F.lit(lo)] if lo is not None else []
    if hi is not None:
        bounds.append(F.col(column) <= F.lit(hi))
    return reduce(Column.__and__, bounds) if bounds else None


def _midnight(day: date | datetime | str) -> datetime:
    parsed = datetime.fromisoformat(day) if isinstance(day, str) else day
    return datetime(parsed.year, parsed.month, parsed.day)


def _dates(column: str, first: date | str | None, last: date | str | None, whole_day: bool) -> Column | None:
    if first is None or last is None:
        return None
    moment = F.col(column).cast("timestamp_ntz")
    start, end = _midnight(first), _midnight(last)
    from_start = moment >= F.lit(start).cast("timestamp_ntz")
    if whole_day:
        return from_start & (moment < F.lit(end + timedelta(days=1)).cast("timestamp_ntz"))
    return from_start & (moment <= F.lit(end).cast("timestamp_ntz"))


def _text(column: str, pattern: str) -> Column | None:
    return F.col(column).cast("string").rlike(pattern) if pattern else None


def _filtered(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.filter(condition)


def filter_in(df: DataFrame, column: str, values: Collection[object] | None) -> DataFrame:
    """Keep the chosen values. NULL (None or NaN) can be chosen; an empty choice keeps nothing, and
    None, no choice made yet, keeps everything."""
    return _filtered(df, _in(column, values))


def filter_range(df: DataFrame, column: str, lo: object, hi: object) -> DataFrame:
    """Keep ``lo <= column <= hi``; a bound that is None does not count."""
    return _filtered(df, _range(column, lo, hi))


def filter_dates(
    df: DataFrame, column: str, first: date | str | None, last: date | str | None, whole_day: bool = False
) -> DataFrame:
    """Keep ``first <= column <= last``, both taken as midnight.

    Later moments of the last day fall out, unless ``whole_day`` is set. With an end
    missing there is no filter.
    """
    return _filtered(df, _dates(column, first, last, whole_day))


def filter_text(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Keep rows whose text form matches the case-sensitive regular expression anywhere."""
    return _filtered(df, _text(column, pattern))


def condition_of(spec: FilterSpec) -> Column | None:
    """The choice as a condition, or None where it keeps every row."""
    if spec.kind == CATEGORICAL:
        return _in(spec.column, spec.values)
    if spec.kind == NUMERIC:
        return _range(spec.column, spec.lo, spec.hi)
    if spec.kind == DATETIME:
        return _dates(spec.column, spec.lo, spec.hi, spec.whole_day)
    if spec.kind == TEXT:
        return _text(spec.column, spec.pattern)
    raise ValueError(f"unknown filter kind {spec.kind!r}")


def apply_filters(df: DataFrame, specs: Sequence[FilterSpec]) -> DataFrame:
    """Apply the choices one after the other."""
    return reduce(lambda frame, spec: _filtered(frame, condition_of(spec)), specs, df)


def state_filter(df: DataFrame, states: Collection[str | None], all_token: str = ALL_STATES,
                 column: str = "estado_escola") -> DataFrame:
    """Rows of the chosen states; the all-token keeps every row, no choice keeps none."""
    return df if all_token in states else filter_in(df, column, states)


def _plain_kind(df: DataFrame, column: str) -> str:
    data_type = df.schema[column].dataType
    if isinstance(data_type, NumericType):
        return NUMERIC
    if isinstance(data_type, (DateType, TimestampType, TimestampNTZType)):
        return DATETIME
    return TEXT


def _measures(df: DataFrame, c: str, max_values: int, exact: bool = False, where: str = "true") -> dict[str, Column]:
    """What the description of a column needs, as aggregates of bounded memory over the rows where
    the condition ``where`` holds."""
    kept = F.expr(where)
    value = F.when(kept, F.col(c))
    least, most = F.min(value), F.max(value)
    step = (most.cast("double") - least.cast("double")) / 100 if _plain_kind(df, c) == NUMERIC else F.lit(None)
    found = {
        # The sketch has at least 2.56 registers per value asked about. At most max_values - 1
        # values fill at most that many of them, which it reads as less than twice as many. So a
        # larger estimate is proof of more.
        "estimate": F.approx_count_distinct(value, min(0.05, 1.106 / (2.56 * max_values) ** 0.5)),
        "min": least.cast("string"),
        "max": most.cast("string"),
        "has_null": F.coalesce(F.bool_or(kept & F.col(c).isNull()), F.lit(False)),
        "step": step.cast("double"),
        # Exact as long as fewer values occur than are tracked; NULL is one of the items.
        "items": F.expr(f"approx_top_k(`{c}`, {2 * max_values + 1}, {32 * max_values}) FILTER (WHERE {where})"),
    }
    if exact:
        found["n"] = F.count_distinct(value)
    return found


def _described(df: DataFrame, c: str, measures: dict[str, Column], max_values: int) -> list[Column]:
    """The description of a column from its measures, as columns of one row."""
    values = F.filter(F.transform(measures["items"], lambda item: item["item"]), lambda value: value.isNotNull())
    categorical = (measures["estimate"] <= 2 * max_values) & (F.size(values) < max_values)
    n = measures.get("n", F.when(categorical, F.size(values)))
    return [
        F.lit(c).alias("column"),
        F.when(categorical, CATEGORICAL).otherwise(_plain_kind(df, c)).alias("kind"),
        n.cast("long").alias("n_distinct"),
        measures["min"].alias("min"),
        measures["max"].alias("max"),
        F.when(~categorical, measures["step"]).cast("double").alias("step"),
        F.when(categorical, F.array_sort(values)).cast("array<string>").alias("values"),
        measures["has_null"].alias("has_null"),
    ]


def profile_columns(
    df: DataFrame,
    max_values: int = 10,
    columns: Sequence[str] | None = None,
    exact_counts: bool = False,
) -> DataFrame:
    """One row per column: which kind of filter it takes, and the bounds of that filter.

    ``kind`` is categorical with fewer than ``max_values`` distinct non-null values, else
    by type. ``values`` lists the values of a categorical column, ``has_null`` tells
    whether NULL is among the choices; ``step`` is a hundredth of a numeric range.
    ``n_distinct`` is given for categorical columns, and with ``exact_counts`` for all.

    The rule only asks "fewer than ten?", so nothing is counted exactly that need not be:
    one lazy aggregate in constant memory finds the bounds, sketches the distinct counts and
    tracks a bounded number of values. ``exact_counts`` costs a shuffle of every column's values.
    """
    if max_values < 1:
        raise ValueError("max_values must be at least 1")
    names = list(columns or df.columns)
    wanted = {c: _measures(df, c, max_values, exact_counts) for c in names}
    counted = df.agg(*[m.alias(f"{c}|{name}") for c, found in wanted.items() for name, m in found.items()])
    described = [
        F.struct(*_described(df, c, {name: F.col(f"`{c}|{name}`") for name in found}, max_values))
        for c, found in wanted.items()
    ]
    return counted.select(F.inline(F.array(*described)))


def filter_facets(df: DataFrame, specs: Sequence[FilterSpec], max_values: int = 10) -> DataFrame:
    """What each filter of a chain offers: the description of its column (as in
    :func:`profile_columns`) on the rows that the filters before it keep.

    ``place`` counts the filters from 1, ``rows`` are the rows that the filters before keep. The whole chain is one
    read of ``df``: every row carries a bit per filter that it passes, and a filter's measures
    aggregate the rows that have all the bits before.
    """
    bits = [F.lit(0)]
    for i, spec in enumerate(specs):
        condition = condition_of(spec)
        bits.append(F.lit(1 << i) if condition is None else F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)))
    marked = df.withColumn("_passed", reduce(Column.bitwiseOR, bits))
    measures, described = [], []
    for i, spec in enumerate(specs):
        before = f"(_passed & {(1 << i) - 1}) = {(1 << i) - 1}"
        found = _measures(df, spec.column, max_values, where=before) | {"rows": F.count_if(F.expr(before))}
        measures += [m.alias(f"{i}|{name}") for name, m in found.items()]
        own = {name: F.col(f"`{i}|{name}`") for name in found}
        described.append(F.struct(
            F.lit(i + 1).alias("place"), *_described(df, spec.column, own, max_values), own["rows"].alias("rows")
        ))
    return marked.agg(*measures).select(F.inline(F.array(*described)))
