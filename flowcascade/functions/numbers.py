"""Scalar helpers: safe column references, casts and missing-value tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def quoted(name: str) -> Column:
    """Column by exact name; flow names contain ``/`` and may contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_double(c: Column) -> Column:
    """Cast to double; text that is no number becomes null instead of an error."""
    return c.try_cast("double")


def looks_numeric(c: Column) -> Column:
    """Is a (non-null) text a number as a CSV reader would type it?

    The JVM also parses ``1d``, ``2F`` and hexadecimal floats; those are text
    for a CSV reader, so they are ruled out here.
    """
    number = to_double(c)
    java_suffix = (
        F.right(F.trim(c), F.lit(1)).isin("d", "D", "f", "F")
        & (F.abs(number) != F.lit(INF))
    )
    hexadecimal = F.contains(F.lower(c), F.lit("x"))
    return number.isNotNull() & ~java_suffix & ~hexadecimal


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_missing(c: Column, floating: bool) -> Column:
    """Null, or NaN for a floating-point column.  Infinities are values."""
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def finite_or_zero(c: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    return F.when(is_finite(c), c).otherwise(F.lit(0.0))
