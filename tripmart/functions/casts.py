"""Casts that give NULL instead of an error, and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int_or_null(c: Column) -> Column:
    """An integer, or NULL where the value is no whole number in range; '2.0' is 2."""
    number = c.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def to_ts_or_null(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def to_double_or_null(c: Column) -> Column:
    """A double; NULL for text that is none, and for NaN."""
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def strip(c: Column) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def to_money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


def label_missing(c: Column, null: str = "[NULL]", empty: str = "[EMPTY STRING]") -> Column:
    return F.when(c.isNull(), null).when(c == "", empty).otherwise(c)


def code_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def mean(total: Column, n: Column, digits: int = 2) -> Column:
    """total / n as an exact decimal, rounded half away from zero; NULL where n is 0."""
    return F.round(total / F.nullif(n, F.lit(0)).cast("decimal(20,0)"), digits)
