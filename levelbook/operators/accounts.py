"""Leaving chosen accounts out."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude_accounts(df: DataFrame, ids: Collection[str] | DataFrame, col: str = "auth_id") -> DataFrame:
    """Rows whose account is known and not one of ``ids``.

    A list becomes a set test inside the scan's filter. A long list can be given as a
    frame (first column): it becomes an anti join, whose strategy Spark picks by size.
    Either way a NULL account drops out, as ``NULL NOT IN (..)`` is not true.
    """
    known = df.filter(F.col(col).isNotNull())
    if isinstance(ids, DataFrame):
        listed = ids.select(F.col(ids.columns[0]).alias(col)).dropna()
        return known.join(listed, col, "left_anti").select(*df.columns)
    listed = sorted({i for i in ids if i is not None})
    return known.filter(~F.col(col).isin(listed)) if listed else known
