"""Columns that put dirty job data into one form: machine names, time units, valid ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds since 1970 stay below this until the year 5138; greater numbers are milliseconds.
MILLIS_FROM = 1e11


def mac_name(c: Column) -> Column:
    """One spelling of a machine's name: blanks off, lower case, no ``.local``; empty is null."""
    x = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"\.local\.?$", "")
    return F.when(x != "", x)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def unix_seconds(c: Column) -> Column:
    """Seconds from a time in seconds or milliseconds; NaN and infinities are null."""
    x = finite(c)
    return F.when(F.abs(x) > MILLIS_FROM, x / 1000.0).otherwise(x)


def unix_millis(c: Column) -> Column:
    """Whole milliseconds from a time in seconds or milliseconds."""
    x = finite(c)
    return F.round(F.when(F.abs(x) > MILLIS_FROM, x).otherwise(x * 1000.0)).cast("long")


def within(c: Column, low: float, high: float) -> Column:
    """``c`` where it lies in [low, high], else null (NaN is null too)."""
    return F.when(c.between(low, high) & ~F.isnan(c), c)
