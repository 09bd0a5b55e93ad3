"""Summary marts over daily and hourly metrics, from staging or from the fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import mean
from ..operators import series
from ..operators.measures import COUNTS, KEYS, trip_measures
from .analytics import DAILY_COLUMNS, HOURLY_COLUMNS


def daily_summary(daily: DataFrame) -> DataFrame:
    """A row per ingestion and day with change, running totals, rolling mean, rank and share."""
    w = series.ordered("pickup_date")
    before = F.col("previous_day_trip_count")
    return daily.withColumn("previous_day_trip_count", series.previous("trip_count", w)).select(
        *DAILY_COLUMNS,
        "previous_day_trip_count",
        (F.col("trip_count") - before).alias("daily_trip_count_change"),
        series.percent_change(F.col("trip_count"), before).alias("daily_trip_count_change_percentage"),
        series.running_sum("trip_count", w).alias("cumulative_trip_count"),
        series.running_sum("net_total_amount", w).cast("decimal(18,2)").alias("cumulative_net_total_amount"),
        series.rolling_mean("trip_count", w, 7).alias("rolling_7_day_average_trip_count"),
        series.demand_rank("trip_count").alias("trip_demand_rank"),
        series.share("trip_count").alias("period_trip_share_percentage"),
    )


def hourly_totals(hourly: DataFrame) -> DataFrame:
    """Hours of all days of an ingestion, with the number of days on which the hour occurs."""
    amounts = ["positive_total_amount", "negative_total_amount", "net_total_amount"]
    return hourly.groupBy(*KEYS, "pickup_hour").agg(
        F.count_distinct("pickup_date").alias("represented_day_count"),
        *[F.sum(c).cast("long").alias(c) for c in ("trip_count", *COUNTS)],
        *[F.sum(c).cast("decimal(18,2)").alias(c) for c in amounts],
    )


def hourly_profile(hourly: DataFrame) -> DataFrame:
    """A row per ingestion and hour of day; the hour before is that of the same day's order, not circular."""
    w = series.ordered("pickup_hour")
    before, n = F.col("previous_hour_trip_count"), F.col("trip_count")
    shares = list(COUNTS)[:4]
    return hourly_totals(hourly).withColumn("previous_hour_trip_count", series.previous("trip_count", w)).select(
        *KEYS,
        "pickup_hour",
        "represented_day_count",
        "trip_count",
        mean(n.cast("decimal(20,0)"), F.col("represented_day_count")).cast("decimal(12,2)").alias("average_daily_trip_count"),
        *COUNTS,
        *[series.percent_of(F.col(c), n).alias(c.replace("_trip_count", "_percentage")) for c in shares],
        "positive_total_amount",
        "negative_total_amount",
        "net_total_amount",
        mean(F.col("net_total_amount"), n).cast("decimal(12,2)").alias("average_net_total_amount_per_trip"),
        "previous_hour_trip_count",
        (n - before).alias("hourly_trip_count_change"),
        series.percent_change(n, before).alias("hourly_trip_count_change_percentage"),
        series.running_sum("trip_count", w).alias("cumulative_trip_count"),
        series.rolling_mean("trip_count", w, 3).alias("rolling_3_hour_average_trip_count"),
        series.demand_rank("trip_count").alias("demand_rank"),
        series.share("trip_count").alias("period_trip_share_percentage"),
    )


def _fact_trips(fact: DataFrame, dim_ingestion: DataFrame, dim_date: DataFrame) -> DataFrame:
    runs = dim_ingestion.where("ingestion_status = 'completed'").select(*KEYS)
    days = dim_date.select(F.col("date_key").alias("pickup_date_key"), F.col("full_date").alias("pickup_date"))
    return fact.where(~F.col("is_pickup_outside_expected_period")).join(runs, "ingestion_id").join(days, "pickup_date_key")


def daily_from_fact(fact: DataFrame, dim_ingestion: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _fact_trips(fact, dim_ingestion, dim_date).groupBy(*KEYS, "pickup_date").agg(*trip_measures()).select(*DAILY_COLUMNS)


def hourly_from_fact(fact: DataFrame, dim_ingestion: DataFrame, dim_date: DataFrame, dim_hour: DataFrame) -> DataFrame:
    hours = dim_hour.select(F.col("hour_key").alias("pickup_hour_key"), F.col("hour_key").cast("int").alias("pickup_hour"))
    trips = _fact_trips(fact, dim_ingestion, dim_date).join(hours, "pickup_hour_key")
    return trips.groupBy(*KEYS, "pickup_date", "pickup_hour").agg(*trip_measures()).select(*HOURLY_COLUMNS)
