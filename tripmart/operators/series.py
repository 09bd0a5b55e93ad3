"""Window measures over a series of rows of one ingestion."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(order: str, partition: str = "ingestion_id") -> WindowSpec:
    return Window.partitionBy(partition).orderBy(order)


def previous(value: str, w: WindowSpec) -> Column:
    return F.lag(value).over(w)


def running_sum(value: str, w: WindowSpec) -> Column:
    """Over rows, not over a range of the order key."""
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def rolling_mean(value: str, w: WindowSpec, rows: int) -> Column:
    """Mean of the last ``rows`` rows present, rounded to two places."""
    frame = w.rowsBetween(1 - rows, Window.currentRow)
    return F.round(F.sum(F.col(value).cast("decimal(20,0)")).over(frame) / F.count(value).over(frame).cast("decimal(20,0)"), 2).cast("decimal(12,2)")


def demand_rank(value: str, partition: str = "ingestion_id") -> Column:
    """Rank by falling value, with gaps after ties."""
    return F.rank().over(Window.partitionBy(partition).orderBy(F.desc(value))).cast("long")


def percent_change(now: Column, before: Column) -> Column:
    """NULL where the value before is missing or not positive."""
    return F.when(before > 0, F.round((now - before).cast("decimal(20,0)") / before.cast("decimal(20,0)") * 100, 2)).cast("decimal(12,2)")


def percent_of(part: Column, whole: Column) -> Column:
    """Percentage to four places; NULL where the whole is 0."""
    return F.round(part.cast("decimal(20,0)") * 100 / F.nullif(whole, F.lit(0)).cast("decimal(20,0)"), 4).cast("decimal(8,4)")


def share(value: str, partition: str = "ingestion_id") -> Column:
    return percent_of(F.col(value), F.sum(value).over(Window.partitionBy(partition)))
