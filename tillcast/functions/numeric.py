"""Rounding and division with the null rules the reports need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even_int(value: Column) -> Column:
    """Round half to even (2.5 gives 2), as int."""
    return F.bround(value, 0).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero or null denominator, also in ANSI mode."""
    return F.try_divide(numerator, denominator)
