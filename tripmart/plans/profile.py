"""Profiling reports over raw trips; periods and thresholds are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import label_missing
from ..functions.trips import duration_minutes
from ..operators.flags import is_speeding
from ..operators.distinct import repeated_rows
from ..operators.quantiles import column_statistics
from ..schema import RAW_COLUMNS

PERIOD = ("2024-01-01", "2024-02-01")


def _count() -> Column:
    return F.count(F.lit(1))


def _sum_if(condition: Column) -> Column:
    """1 for each row that meets the condition; NULL on no rows at all."""
    return F.sum(F.when(condition, 1).otherwise(0))


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def of_ingestion(trips: DataFrame, ingestion_id: int) -> DataFrame:
    return trips.where(F.col("ingestion_id") == ingestion_id)


def preview(trips: DataFrame, n: int = 10) -> DataFrame:
    columns = ["raw_trip_id", "ingestion_id", "pickup_datetime", "dropoff_datetime", "passenger_count", "trip_distance", "total_amount"]
    return trips.orderBy("raw_trip_id").limit(n).select(*columns)


def row_counts(trips: DataFrame) -> DataFrame:
    return trips.groupBy("ingestion_id").agg(_count().alias("trip_count"))


def total_rows(trips: DataFrame) -> DataFrame:
    return trips.agg(_count().alias("total_rows"))


def null_counts(trips: DataFrame, columns=tuple(RAW_COLUMNS)) -> DataFrame:
    """A row per column with its nulls and their percentage, from one pass."""
    counts = trips.agg(_count().alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot(["__rows"], list(columns), "column_name", "null_count")
    share = F.round(F.col("null_count").cast("decimal(20,0)") * 100 / F.nullif("__rows", F.lit(0)).cast("decimal(20,0)"), 4).cast("decimal(8,4)")
    return long.select("column_name", "null_count", share.alias("null_percentage"))


def null_patterns(trips: DataFrame) -> DataFrame:
    passenger, rate = F.col("passenger_count").isNull(), F.col("ratecode_id").isNull()
    return trips.agg(
        F.count_if(passenger & rate).alias("both_columns_null"),
        F.count_if(passenger & ~rate).alias("only_passenger_count_null"),
        F.count_if(~passenger & rate).alias("only_ratecode_id_null"),
    )


def missing_passengers(trips: DataFrame, n: int = 10) -> DataFrame:
    rows = trips.where(F.col("passenger_count").isNull()).orderBy("raw_trip_id").limit(n)
    return rows.select("raw_trip_id", "vendor_id", "pickup_datetime", "passenger_count", "ratecode_id", "payment_type")


def distribution(trips: DataFrame, column: str) -> DataFrame:
    """Rows by value, null being a value."""
    return trips.groupBy(column).agg(_count().alias("trip_count"))


def category_nulls(trips: DataFrame) -> DataFrame:
    payment, passenger, rate = F.col("payment_type"), F.col("passenger_count").isNull(), F.col("ratecode_id").isNull()
    return trips.agg(
        F.count_if((payment == 0) & passenger & rate).alias("payment_type_zero_and_both_null"),
        F.count_if((payment == 0) & (~passenger | ~rate)).alias("payment_type_zero_with_any_value"),
        F.count_if((payment != 0) & (passenger | rate)).alias("nonzero_payment_type_with_any_null"),
    )


def numeric_summary(trips: DataFrame, columns=("trip_distance", "fare_amount", "total_amount")) -> DataFrame:
    """Extremes, mean and sum of each column; sums of doubles are exact to eight places."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,8)"))
    out = []
    for c in columns:
        out += [F.min(c).alias(f"minimum_{c}"), F.max(c).alias(f"maximum_{c}"), F.round(exact(c), 2).cast("decimal(18,2)").alias(f"sum_{c}")]
        out.append(F.round(exact(c) / F.nullif(F.count(c), F.lit(0)).cast("decimal(20,0)"), 2).cast("decimal(12,2)").alias(f"average_{c}"))
    return trips.agg(*out)


def threshold_counts(trips: DataFrame, columns=("trip_distance", "fare_amount", "total_amount"), limits=(100, 1000)) -> DataFrame:
    out = []
    for c in columns:
        out += [_sum_if(F.col(c) == 0).alias(f"{c}_zero"), _sum_if(F.col(c) < 0).alias(f"{c}_negative")]
        out += [_sum_if(F.col(c) > n).alias(f"{c}_over_{n}") for n in limits]
    return trips.agg(*out)


def sign_combinations(trips: DataFrame) -> DataFrame:
    fare, total = F.col("fare_amount"), F.col("total_amount")
    return trips.agg(
        _count().alias("total_rows"),
        (_count() - F.count(fare)).alias("fare_amount_null_rows"),
        (_count() - F.count(total)).alias("total_amount_null_rows"),
        F.count_if((fare < 0) & (total < 0)).alias("both_amounts_negative"),
        F.count_if((fare < 0) & (total >= 0)).alias("negative_fare_nonnegative_total"),
        F.count_if((fare >= 0) & (total < 0)).alias("nonnegative_fare_negative_total"),
    )


def datetime_profile(trips: DataFrame, period: tuple[str, str] = PERIOD) -> DataFrame:
    pickup, dropoff, start, end = F.col("pickup_datetime"), F.col("dropoff_datetime"), _ts(period[0]), _ts(period[1])
    return trips.agg(
        F.min(pickup).alias("minimum_pickup_datetime"), F.max(pickup).alias("maximum_pickup_datetime"),
        F.min(dropoff).alias("minimum_dropoff_datetime"), F.max(dropoff).alias("maximum_dropoff_datetime"),
        _sum_if(pickup < start).alias("pickup_before_period"), _sum_if((pickup >= start) & (pickup < end)).alias("pickup_during_period"), _sum_if(pickup >= end).alias("pickup_after_period"),
        (_count() - F.count(pickup)).alias("pickup_datetime_null_rows"), (_count() - F.count(dropoff)).alias("dropoff_datetime_null_rows"),
        _sum_if(dropoff <= pickup).alias("nonpositive_duration_rows"), _sum_if(dropoff - pickup > F.expr("INTERVAL '24' HOUR")).alias("duration_over_24_hours_rows"),
    )


def shortest_durations(trips: DataFrame, n: int = 10) -> DataFrame:
    """Trips that end before or when they begin, the worst first; trip_duration is an interval."""
    duration = (F.col("dropoff_datetime") - F.col("pickup_datetime")).alias("trip_duration")
    rows = trips.where(F.col("dropoff_datetime") <= F.col("pickup_datetime"))
    return rows.select("raw_trip_id", "pickup_datetime", "dropoff_datetime", duration, "trip_distance", "total_amount").orderBy("trip_duration", "raw_trip_id").limit(n)


def distinct_values(trips: DataFrame, column: str) -> DataFrame:
    return trips.select(column).distinct()


def vendor_by_payment(trips: DataFrame) -> DataFrame:
    return trips.groupBy("vendor_id", "payment_type").agg(_count().alias("trip_count"))


def flag_labels(trips: DataFrame) -> DataFrame:
    return trips.groupBy(label_missing(F.col("store_and_fwd_flag")).alias("store_and_fwd_value")).agg(_count().alias("trip_count"))


def rare_groups(trips: DataFrame, column: str, below: int) -> DataFrame:
    return distribution(trips, column).where(F.col("trip_count") < below)


def trips_with_run(trips: DataFrame, log: DataFrame, n: int = 10) -> DataFrame:
    runs = log.select("ingestion_id", "source_file_name", "taxi_type", "period_year", "period_month", "status")
    rows = trips.orderBy("raw_trip_id").limit(n)
    return rows.join(runs, "ingestion_id").select("raw_trip_id", "pickup_datetime", "trip_distance", "total_amount", "ingestion_id", "source_file_name", "taxi_type", "period_year", "period_month", "status")


def loaded_and_stored(trips: DataFrame, log: DataFrame) -> DataFrame:
    """Rows that each run says it loaded and rows that are there; runs without trips have 0."""
    stored = trips.groupBy("ingestion_id").agg(F.count("raw_trip_id").alias("n"))
    return log.join(stored, "ingestion_id", "left").select("ingestion_id", "source_file_name", "status", "rows_loaded", F.coalesce("n", F.lit(0)).cast("long").alias("database_trip_count"))


def orphan_rows(trips: DataFrame, log: DataFrame) -> DataFrame:
    return trips.join(log.select("ingestion_id"), "ingestion_id", "left_anti").agg(_count().alias("orphan_trip_rows"))


def profile_summary(trips: DataFrame, period: tuple[str, str] = PERIOD) -> DataFrame:
    """One row of counts and percentages."""
    pickup, dropoff = F.col("pickup_datetime"), F.col("dropoff_datetime")
    percent = lambda c: F.round(_sum_if(c).cast("decimal(20,0)") * 100 / F.nullif(_count(), F.lit(0)).cast("decimal(20,0)"), 4).cast("decimal(8,4)")
    card, zero = F.col("payment_type") == 0, F.col("trip_distance") == 0
    return trips.agg(
        _count().alias("total_rows"), _sum_if(card).alias("payment_type_zero_rows"), percent(card).alias("payment_type_zero_percentage"),
        _sum_if(zero).alias("zero_distance_rows"), percent(zero).alias("zero_distance_percentage"),
        _sum_if(F.col("fare_amount") < 0).alias("negative_fare_rows"), _sum_if(F.col("total_amount") < 0).alias("negative_total_rows"),
        _sum_if(dropoff <= pickup).alias("nonpositive_duration_rows"), _sum_if(dropoff - pickup > F.expr("INTERVAL '24' HOUR")).alias("duration_over_24_hours_rows"),
        _sum_if((pickup < _ts(period[0])) | (pickup >= _ts(period[1]))).alias("pickup_outside_period_rows"),
    )


def with_explored_speed(trips: DataFrame) -> DataFrame:
    """Duration and speed by the looser rule of exploration: any positive duration counts."""
    minutes = duration_minutes(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    t = trips.withColumn("trip_duration_minutes", minutes)
    return t.withColumn("average_speed_mph", F.when(F.col("trip_duration_minutes") > 0, F.col("trip_distance") / (F.col("trip_duration_minutes") / 60)))


def duplicate_rows(trips: DataFrame, columns=tuple(RAW_COLUMNS)) -> DataFrame:
    """Rows that repeat an earlier one in all columns; nulls are equal."""
    return repeated_rows(trips, list(columns))


def quality_summary(trips: DataFrame, period: tuple[str, str] = PERIOD, limit: float = 80.0) -> DataFrame:
    """Eight indicators with counts and percentages of all rows."""
    t = with_explored_speed(trips)
    pickup = F.col("pickup_datetime")
    rules = {
        "non_positive_duration": F.col("trip_duration_minutes") <= 0,
        "negative_distance": F.col("trip_distance") < 0,
        "zero_distance": F.col("trip_distance") == 0,
        "negative_fare": F.col("fare_amount") < 0,
        "negative_total_amount": F.col("total_amount") < 0,
        "pickup_outside_period": (pickup < _ts(period[0])) | (pickup >= _ts(period[1])),
        "speed_over_limit": is_speeding(F.col("average_speed_mph"), limit),
    }
    counts = t.agg(_count().alias("__rows"), *[F.count_if(c).alias(k) for k, c in rules.items()]).crossJoin(duplicate_rows(trips).withColumnRenamed("duplicate_rows", "complete_duplicates"))
    long = counts.unpivot(["__rows"], ["complete_duplicates", *rules], "indicator", "record_count")
    share = F.round(F.col("record_count").cast("decimal(20,0)") * 100 / F.nullif("__rows", F.lit(0)).cast("decimal(20,0)"), 4).cast("decimal(8,4)")
    return long.select("indicator", "record_count", share.alias("percentage"))


def describe(trips: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, a row per column, from one pass over the trips."""
    return column_statistics(trips, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def negative_transactions(trips: DataFrame) -> DataFrame:
    columns = ["raw_trip_id", "vendor_id", "pickup_datetime", "payment_type", "fare_amount", "tip_amount", "total_amount"]
    return trips.where((F.col("fare_amount") < 0) | (F.col("total_amount") < 0)).select(*columns)


def zero_distances(trips: DataFrame) -> DataFrame:
    return with_explored_speed(trips).where("trip_distance = 0").select("raw_trip_id", "pickup_datetime", "dropoff_datetime", "trip_distance", "trip_duration_minutes", "total_amount")


def speeding(trips: DataFrame, limit: float = 80.0, n: int = 20) -> DataFrame:
    """The fastest trips above the limit."""
    t = with_explored_speed(trips).where(is_speeding(F.col("average_speed_mph"), limit))
    return t.orderBy(F.desc("average_speed_mph"), "raw_trip_id").limit(n).select("raw_trip_id", "trip_distance", "trip_duration_minutes", "average_speed_mph")


def nonpositive_durations(trips: DataFrame) -> DataFrame:
    return with_explored_speed(trips).where("trip_duration_minutes <= 0").select("raw_trip_id", "pickup_datetime", "dropoff_datetime", "trip_duration_minutes", "trip_distance", "total_amount")


def _of(report, *args):
    return lambda m: report(of_ingestion(m.raw, m.main), *args)


def _statistics(m):
    """Statistics of negative transactions, rounded to four places."""
    out = describe(negative_transactions(of_ingestion(m.raw, m.main)), ["fare_amount", "tip_amount", "total_amount"])
    return out.select("column_name", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def _shortest(m):
    rows = shortest_durations(of_ingestion(m.raw, m.main))
    seconds = F.timestamp_diff("SECOND", F.col("pickup_datetime"), F.col("dropoff_datetime"))
    return rows.withColumn("trip_duration_seconds", seconds).drop("trip_duration")


REPORTS = {
    "r01_preview": _of(preview),
    "r02_row_counts": lambda m: row_counts(m.raw),
    "r02_total_rows": lambda m: total_rows(m.raw),
    "r03_null_counts": _of(null_counts),
    "r04_null_patterns": _of(null_patterns),
    "r04_missing_passengers": _of(missing_passengers),
    "r05_payment_distribution": _of(distribution, "payment_type"),
    "r05_vendor_distribution": _of(distribution, "vendor_id"),
    "r05_ratecode_distribution": _of(distribution, "ratecode_id"),
    "r06_category_nulls": _of(category_nulls),
    "r07_numeric_summary": _of(numeric_summary),
    "r08_threshold_counts": _of(threshold_counts),
    "r09_sign_combinations": _of(sign_combinations),
    "r10_datetime_profile": _of(datetime_profile),
    "r10_shortest_durations": _shortest,
    "r11_distinct_flags": _of(distinct_values, "store_and_fwd_flag"),
    "r11_vendor_by_payment": _of(vendor_by_payment),
    "r12_flag_labels": _of(flag_labels),
    "r12_rare_vendors": _of(rare_groups, "vendor_id", 2000),
    "r12_rare_payments": _of(rare_groups, "payment_type", 100),
    "r13_trips_with_run": lambda m: trips_with_run(of_ingestion(m.raw, m.main), m.log),
    "r13_loaded_and_stored": lambda m: loaded_and_stored(m.raw, m.log),
    "r13_orphan_rows": lambda m: orphan_rows(m.raw, m.log),
    "r14_profile_summary": _of(profile_summary),
    "r15_quality_summary": _of(quality_summary),
    "r15_duplicate_rows": _of(duplicate_rows),
    "r16_negative_transactions": _of(negative_transactions),
    "r16_amount_statistics": _statistics,
    "r17_zero_distances": _of(zero_distances),
    "r17_speeding": _of(speeding),
    "r17_nonpositive_durations": _of(nonpositive_durations),
}
