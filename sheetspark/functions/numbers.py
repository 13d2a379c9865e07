"""Numeric expressions that never raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import is_fractional, is_numeric

# Texts read as numbers. The cast alone would also take '1d', '2f' and '0x1p3'.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def to_number(value: Column, dtype: T.DataType | None = None) -> Column:
    """Double or null; NaN counts as null."""
    if dtype is not None and is_numeric(dtype):
        number = value.cast("double")
        return F.when(~F.isnan(number), number) if is_fractional(dtype) else number
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    return F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))


def to_number_or_zero(value: Column, dtype: T.DataType | None = None) -> Column:
    return F.coalesce(to_number(value, dtype), F.lit(0.0))


def finite(value: Column) -> Column:
    """+-infinity and NaN become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def round_half_even_scaled(value: Column, places: int = 2) -> Column:
    """Round the scaled binary value half to even, as array libraries do."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def two_decimals(value: Column) -> Column:
    """Two decimals from the decimal text of the double, half up."""
    bounded = F.abs(value) < 1e17
    exact = F.round(value.try_cast("decimal(38,12)"), 2).cast("double")
    return F.when(bounded, exact).otherwise(value)


def percent_of(part: Column, whole: Column) -> Column:
    """0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double") * 100.0, whole), F.lit(0.0))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end."""
    return F.timestamp_diff("MILLISECOND", start, end)


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def is_error(status: Column) -> Column:
    return status >= 400
