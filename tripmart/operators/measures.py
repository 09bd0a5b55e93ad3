"""Measures that the daily and hourly aggregates share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.casts import mean

KEYS = ["ingestion_id", "source_file_name", "taxi_type", "period_year", "period_month"]
COUNTS = {
    "operational_issue_trip_count": "has_operational_issue",
    "suspicious_condition_trip_count": "has_suspicious_condition",
    "any_quality_flag_trip_count": "has_any_quality_flag",
    "negative_transaction_trip_count": "is_negative_transaction",
    "valid_speed_trip_count": "is_valid_for_speed_analysis",
}
MEASURES = [
    "trip_count", *COUNTS, "total_trip_distance", "average_trip_distance", "average_trip_duration_minutes", "average_speed_mph",
    "positive_total_amount", "negative_total_amount", "net_total_amount", "average_total_amount",
]
LONGEST_MINUTES = 1440


def _exact_mean(value: Column, keep: Column) -> Column:
    """Mean of doubles as decimals of eight places, so that it doesn't depend on the order of rows."""
    kept = F.when(keep, value.cast("decimal(20,8)"))
    return mean(F.sum(kept), F.count(kept)).cast("decimal(12,2)")


def trip_measures() -> list[Column]:
    """One pass of conditional aggregates."""
    distance, minutes, total = F.col("trip_distance"), F.col("trip_duration_minutes"), F.col("total_amount")
    fine = F.coalesce(distance >= 0, F.lit(False))
    amount = lambda keep: F.coalesce(F.sum(F.when(keep, total)), F.lit(0)).cast("decimal(18,2)")
    return [
        F.count(F.lit(1)).alias("trip_count"),
        *[F.count_if(F.col(flag)).alias(name) for name, flag in COUNTS.items()],
        F.round(F.sum(F.when(fine, distance.cast("decimal(20,8)"))), 2).cast("decimal(18,2)").alias("total_trip_distance"),
        _exact_mean(distance, fine).alias("average_trip_distance"),
        _exact_mean(minutes, ~F.col("has_operational_issue") & (minutes <= LONGEST_MINUTES)).alias("average_trip_duration_minutes"),
        _exact_mean(F.col("average_speed_mph"), F.col("is_valid_for_speed_analysis")).alias("average_speed_mph"),
        amount(total > 0).alias("positive_total_amount"),
        amount(total < 0).alias("negative_total_amount"),
        amount(F.lit(True)).alias("net_total_amount"),
        mean(F.sum(total), F.count(total)).cast("decimal(12,2)").alias("average_total_amount"),
    ]
