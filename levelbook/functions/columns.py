"""Column expressions shared by the plans. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelbook.functions.vocabulary import MONTH_NAMES


def _lookup(mapping: Mapping, column: Column) -> Column:
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def percentage(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, 2 digits, halves up.

    The product is taken first, so only one division rounds and a half stays a half.
    """
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), 2)


def share(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, unrounded; 0 where ``whole`` is not positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def month_number_from_text(column: Column) -> Column:
    """The leading digits of a month kept as text; 0 where there are none."""
    digits = F.regexp_extract(column, r"^\s*\+?(\d+)", 1)
    return F.when(column.isNull(), F.lit(None)).otherwise(
        F.coalesce(digits.try_cast("int"), F.lit(0))
    )


def month_name(number: Column) -> Column:
    """Month 1..12 to its Portuguese name; NULL for any other number."""
    return _lookup({i + 1: name for i, name in enumerate(MONTH_NAMES)}, number)


def month_number(name: Column) -> Column:
    """The inverse of :func:`month_name`, for sorting by calendar instead of by text."""
    return _lookup({name: i + 1 for i, name in enumerate(MONTH_NAMES)}, name)


def relabel(column: Column, labels: Mapping[str, str]) -> Column:
    """Exact-value replacement; values without a label, and NULL, stay as they are."""
    return F.coalesce(_lookup(labels, column), column) if labels else column


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from ``start`` to ``end`` with the microseconds kept."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)
