"""Durations, speeds and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(pickup: Column, dropoff: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", pickup, dropoff) / F.lit(1e6)


def duration_minutes(pickup: Column, dropoff: Column) -> Column:
    """Minutes between two timestamps; negative ones are kept."""
    return seconds(pickup, dropoff) / F.lit(60.0)


def speed_mph(pickup: Column, dropoff: Column, distance: Column) -> Column:
    """Miles an hour where the dropoff is later and the distance positive, else NULL."""
    return F.when((dropoff > pickup) & (distance > 0), distance / (seconds(pickup, dropoff) / F.lit(3600.0)))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def date_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(day))


def day_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _DAYS)), F.weekday(day) + 1)
