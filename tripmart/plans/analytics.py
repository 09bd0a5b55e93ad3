"""Daily and hourly metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.measures import KEYS, MEASURES, trip_measures

DAILY_KEYS = [*KEYS, "pickup_date"]
HOURLY_KEYS = [*KEYS, "pickup_date", "pickup_hour"]
DAILY_COLUMNS, HOURLY_COLUMNS = [*DAILY_KEYS, *MEASURES], [*HOURLY_KEYS, *MEASURES]


def eligible_daily(staging: DataFrame) -> DataFrame:
    """Trips of completed ingestions with a pickup date inside the expected month."""
    return staging.where((F.col("ingestion_status") == "completed") & F.col("pickup_date").isNotNull() & ~F.col("is_pickup_outside_expected_period"))


def eligible_hourly(staging: DataFrame) -> DataFrame:
    return eligible_daily(staging).where(F.col("pickup_hour").isNotNull())


def daily_metrics(staging: DataFrame) -> DataFrame:
    return eligible_daily(staging).groupBy(*DAILY_KEYS).agg(*trip_measures()).select(*DAILY_COLUMNS)


def hourly_metrics(staging: DataFrame) -> DataFrame:
    return eligible_hourly(staging).groupBy(*HOURLY_KEYS).agg(*trip_measures()).select(*HOURLY_COLUMNS)


def hourly_rolled_up(hourly: DataFrame) -> DataFrame:
    """Additive measures of the hours of a day."""
    sums = ["trip_count", "operational_issue_trip_count", "suspicious_condition_trip_count", "any_quality_flag_trip_count", "negative_transaction_trip_count", "valid_speed_trip_count", "total_trip_distance", "positive_total_amount", "negative_total_amount", "net_total_amount"]
    kinds = dict(hourly.dtypes)
    return hourly.groupBy("ingestion_id", "pickup_date").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums])
