"""Column expressions shared by the operators; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become null."""
    value = col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def number(c: str | Column) -> Column:
    """Numeric reading of any column; what cannot be read is null."""
    return finite(col(c).try_cast("double"))


def change(now: Column, before: Column) -> Column:
    """now / before - 1, null when the base is zero or missing."""
    return F.try_divide(now, before) - 1


def clip(c: str | Column, low: Column, high: Column) -> Column:
    """Clip to the bounds; null values stay null and null bounds do not clip."""
    value = col(c)
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def rounded(c: str | Column, digits: int) -> Column:
    """Rounded half up, with negative zero folded into zero."""
    value = F.round(col(c), digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
