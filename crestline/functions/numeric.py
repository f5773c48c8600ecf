"""Rounding and printing as browsers do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Half towards plus infinity, exact just below one half; bigint."""
    whole = F.floor(x)
    return whole + F.when(x - whole >= 0.5, 1).otherwise(0)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x))


def fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


def micro_degrees(x: Column) -> Column:
    """A degree as a whole number of millionths: the identity of a coordinate, as a number and not as text."""
    return js_round(x * F.lit(1e6))


def number_or(x: Column, fallback: Column) -> Column:
    """x as a double; absent counts as 0, not a number as the fallback."""
    return F.when(x.isNull() | (F.trim(x) == ""), F.lit(0.0)).otherwise(F.coalesce(x.try_cast("double"), fallback))
