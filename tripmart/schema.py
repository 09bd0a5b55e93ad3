"""Column lists, code tables and schemas of the trip warehouse."""

from __future__ import annotations

from pyspark.sql import types as T

#: Source column to raw column (fixed values).
SOURCE_COLUMNS = {
    "VendorID": "vendor_id",
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
    "passenger_count": "passenger_count",
    "trip_distance": "trip_distance",
    "RatecodeID": "ratecode_id",
    "store_and_fwd_flag": "store_and_fwd_flag",
    "PULocationID": "pickup_location_id",
    "DOLocationID": "dropoff_location_id",
    "payment_type": "payment_type",
    "fare_amount": "fare_amount",
    "extra": "extra",
    "mta_tax": "mta_tax",
    "tip_amount": "tip_amount",
    "tolls_amount": "tolls_amount",
    "improvement_surcharge": "improvement_surcharge",
    "total_amount": "total_amount",
    "congestion_surcharge": "congestion_surcharge",
    "Airport_fee": "airport_fee",
    "cbd_congestion_fee": "cbd_congestion_fee",
}
RAW_COLUMNS = list(SOURCE_COLUMNS.values())
#: Column groups (fixed values).
INTEGER_COLUMNS = ["vendor_id", "passenger_count", "ratecode_id", "pickup_location_id", "dropoff_location_id", "payment_type"]
TIMESTAMP_COLUMNS = ["pickup_datetime", "dropoff_datetime"]
TEXT_COLUMNS = ["store_and_fwd_flag"]
MONEY_COLUMNS = ["fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount", "congestion_surcharge", "airport_fee", "cbd_congestion_fee"]
DOUBLE_COLUMNS = ["trip_distance", *MONEY_COLUMNS]

#: Code tables (fixed values).
VENDORS = {1: "Creative Mobile Technologies, LLC", 2: "Curb Mobility, LLC", 6: "Myle Technologies Inc", 7: "Helix"}
RATECODES = {1: "Standard rate", 2: "JFK", 3: "Newark", 4: "Nassau or Westchester", 5: "Negotiated fare", 6: "Group ride", 99: "Unknown"}
PAYMENTS = {0: "Flex Fare trip", 1: "Credit card", 2: "Cash", 3: "No charge", 4: "Dispute", 5: "Unknown", 6: "Voided trip"}
STORE_AND_FWD = {"Y": "Store and forward trip", "N": "Not a store and forward trip"}
UNRECOGNIZED, MISSING = "Unrecognized", "Missing"
UNKNOWN_RATECODE, UNKNOWN_PAYMENT = 99, 5

#: Schema and states of the audit log (fixed values).
LOG = T.StructType(
    [
        T.StructField("ingestion_id", T.LongType(), False),
        T.StructField("source_file_name", T.StringType(), False),
        T.StructField("taxi_type", T.StringType(), False),
        T.StructField("period_year", T.IntegerType(), False),
        T.StructField("period_month", T.IntegerType(), False),
        T.StructField("file_size_bytes", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("rows_read", T.LongType(), False),
        T.StructField("rows_loaded", T.LongType(), False),
        T.StructField("rows_rejected", T.LongType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("completed_at", T.TimestampType(), True),
        T.StructField("error_message", T.StringType(), True),
    ]
)
STATUSES = ["started", "completed", "failed", "skipped"]

#: Quality flags of a trip (fixed values).
FLAGS = [
    "has_missing_datetime", "is_nonpositive_duration", "is_duration_over_24_hours", "is_negative_distance", "is_zero_distance",
    "is_pickup_outside_expected_period", "has_missing_trip_attributes", "is_negative_fare", "is_negative_total_amount", "is_negative_transaction",
    "is_unrecognized_vendor", "is_unrecognized_ratecode", "is_unrecognized_payment_type", "is_unrecognized_store_and_fwd",
    "is_documented_unknown_ratecode", "is_documented_unknown_payment_type", "has_operational_issue", "has_suspicious_condition",
    "has_any_quality_flag", "is_valid_for_speed_analysis",
]
