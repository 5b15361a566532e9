"""Typed helpers: timestamps as the text that the rules read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def fixed_text(value: Column, digits: int = 2) -> Column:
    """A double with a fixed number of decimals, rounded half up on the scaled value."""
    scaled = F.round(value * 10**digits).cast("long")
    unit = 10**digits
    whole, rest = F.floor(F.abs(scaled) / F.lit(unit)).cast("long"), F.abs(scaled) % unit
    return F.concat(F.when(scaled < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))
