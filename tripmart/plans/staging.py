"""Staging: one row per raw row, typed money, decoded codes, derived columns and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decode
from ..functions.casts import to_money
from ..functions.trips import duration_minutes, speed_mph
from ..operators.flags import basic_flags, derived_flags
from ..schema import FLAGS, MONEY_COLUMNS

STAGING_COLUMNS = [
    "raw_trip_id", "ingestion_id", "source_file_name", "taxi_type", "period_year", "period_month", "ingestion_status", "vendor_id",
    "pickup_datetime", "dropoff_datetime", "passenger_count", "trip_distance", "ratecode_id", "store_and_fwd_flag",
    "pickup_location_id", "dropoff_location_id", "payment_type", "vendor_name", "ratecode_name", "payment_type_name",
    "store_and_fwd_description", *MONEY_COLUMNS, "loaded_at", "pickup_date", "pickup_hour", "trip_duration_minutes",
    "average_speed_mph", *FLAGS,
]


def staging_trips(trips: DataFrame, log: DataFrame) -> DataFrame:
    """Raw trips with their audit row. The audit log has a row a run; Spark broadcasts it while it is small."""
    runs = log.select("ingestion_id", "source_file_name", "taxi_type", "period_year", "period_month", F.col("status").alias("ingestion_status"))
    t = trips.join(runs, "ingestion_id")
    pickup, dropoff = F.col("pickup_datetime"), F.col("dropoff_datetime")
    columns = {
        "vendor_name": decode.decode_vendor(F.col("vendor_id")),
        "ratecode_name": decode.decode_ratecode(F.col("ratecode_id")),
        "payment_type_name": decode.decode_payment(F.col("payment_type")),
        "store_and_fwd_description": decode.decode_store_fwd(F.col("store_and_fwd_flag")),
        "pickup_date": F.to_date(pickup),
        "pickup_hour": F.hour(pickup),
        "trip_duration_minutes": duration_minutes(pickup, dropoff),
        "average_speed_mph": speed_mph(pickup, dropoff, F.col("trip_distance")),
    }
    t = t.withColumns(columns | basic_flags()).withColumns(derived_flags())
    return t.withColumns({c: to_money(F.col(c)) for c in MONEY_COLUMNS}).select(*STAGING_COLUMNS)
