"""Type repairs done before filtering.

Where the new schema depends on the values, one small aggregate (one row to the driver)
decides it; the frame itself stays lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, NumericType, StringType, TimestampType

from levelbook.functions.vocabulary import DATE_TEXT_PATTERN


def _columns_of(df: DataFrame, *types: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def normalize_ints(df: DataFrame) -> DataFrame:
    """Fractional columns that hold whole numbers only become integers; NULL stays NULL."""
    fractional = _columns_of(df, DoubleType, FloatType, DecimalType)
    if not fractional:
        return df
    # The largest long itself is not a double, so the bound below is the first one beyond it.
    whole = df.agg(*[
        F.bool_and((F.col(c) == F.floor(c)) & (F.abs(F.col(c)) < F.lit(2.0**63))).alias(c) for c in fractional
    ]).first()
    return df.withColumns({c: F.col(c).cast("long") for c in fractional if whole[c]})


def fill_null_numeric(df: DataFrame) -> DataFrame:
    """NULL becomes 0 in numeric columns."""
    return df.fillna(0, subset=_columns_of(df, NumericType))


def infer_dates(df: DataFrame, pattern: str = DATE_TEXT_PATTERN) -> DataFrame:
    """Text columns whose every value shows ``pattern`` and reads as a date become timestamps.

    All values of a column have to be written alike; otherwise the column stays text.
    """
    texts = _columns_of(df, StringType)
    if not texts:
        return df

    def parsed(c: str) -> Column:
        return F.replace(c, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")

    def checks(c: str) -> list[Column]:
        shape = F.regexp_replace(c, r"\d", "0")
        dated = F.col(c).rlike(pattern) & parsed(c).isNotNull()
        return [
            F.bool_and(F.when(F.col(c).isNotNull(), dated)).alias(f"{c}|dated"),
            (F.min(shape) == F.max(shape)).alias(f"{c}|alike"),
        ]

    found = df.agg(*[check for c in texts for check in checks(c)]).first()
    return df.withColumns({c: parsed(c) for c in texts if found[f"{c}|dated"] and found[f"{c}|alike"]})


def strip_tz(df: DataFrame) -> DataFrame:
    """Zoned timestamps become wall-clock timestamps of the session's zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in _columns_of(df, TimestampType)})


def ids_as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ids as plain digits, so that no display puts separators into them."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})
