"""Numeric expressions with pandas-like rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def parse_number(text: Column) -> Column:
    """Text to double; text that is not a plain decimal number becomes null.

    The cast also takes Java spellings such as ``5d``, ``0x1p3`` and ``Infinity``. A plain number ends
    in a digit or a point and has no x; these two tests cost far less per row than a regular expression.
    """
    plain = F.substring(F.rtrim(text), -1, 1).between(".", "9") & ~text.contains("x") & ~text.contains("X")
    return F.when(plain, text.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column.

    Sources apply it, because Spark takes NaN as the greatest number where the operators mean "missing".
    """
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: nan_to_null(F.col(name)) for name in floats}) if floats else df


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio as double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def at_least(value: Column, low) -> Column:
    """``max(value, low)`` where a missing value stays missing."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def at_most(value: Column, high) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(high)))


def clip(value: Column, low, high) -> Column:
    return at_least(at_most(value, high), low)


def truncate(value: Column, to: str = "int") -> Column:
    """Integer part, toward zero."""
    return value.cast(to)


def text_length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def min_max(value: Column, low: Column, high: Column) -> Column:
    return F.try_divide(value - low, high - low)
