import datetime as dt

import pytest

from tripmart.plans.analytics import daily_metrics
from tripmart.plans.staging import STAGING_COLUMNS, staging_trips
from tripmart.schema import FLAGS, MONEY_COLUMNS

T0 = dt.datetime(2024, 12, 5, 10)
BASE = dict(
    raw_trip_id=1, ingestion_id=7, vendor_id=1, pickup_datetime=T0, dropoff_datetime=T0 + dt.timedelta(minutes=30), passenger_count=1, trip_distance=5.0, ratecode_id=1,
    store_and_fwd_flag="N", pickup_location_id=1, dropoff_location_id=2, payment_type=1, **dict.fromkeys(MONEY_COLUMNS, 1.0), loaded_at=T0,
)
KINDS = {"raw_trip_id": "long", "ingestion_id": "long", "pickup_datetime": "timestamp_ntz", "dropoff_datetime": "timestamp_ntz", "loaded_at": "timestamp_ntz", "store_and_fwd_flag": "string", "trip_distance": "double"} | dict.fromkeys(MONEY_COLUMNS, "double")


def stage(spark, **change):
    row = BASE | change
    raw = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {KINDS.get(k, 'int')}" for k in row))
    log = spark.createDataFrame([(7, "f.parquet", "yellow", 2024, 12, "completed")], "ingestion_id long, source_file_name string, taxi_type string, period_year int, period_month int, status string")
    return staging_trips(raw, log)


CASES = [
    ({}, {"is_valid_for_speed_analysis"}),
    ({"pickup_datetime": None}, {"has_missing_datetime", "has_operational_issue", "has_any_quality_flag"}),
    ({"dropoff_datetime": T0}, {"is_nonpositive_duration", "has_operational_issue", "has_any_quality_flag"}),
    ({"dropoff_datetime": T0 + dt.timedelta(hours=24)}, {"is_valid_for_speed_analysis"}),
    ({"dropoff_datetime": T0 + dt.timedelta(hours=24, microseconds=1)}, {"is_duration_over_24_hours", "has_suspicious_condition", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
    ({"trip_distance": -1.0}, {"is_negative_distance", "has_operational_issue", "has_any_quality_flag"}),
    ({"trip_distance": 0.0}, {"is_zero_distance", "has_suspicious_condition", "has_any_quality_flag"}),
    ({"trip_distance": None}, set()),
    ({"pickup_datetime": dt.datetime(2024, 12, 1), "dropoff_datetime": dt.datetime(2024, 12, 1, 1)}, {"is_valid_for_speed_analysis"}),
    ({"pickup_datetime": dt.datetime(2025, 1, 1), "dropoff_datetime": dt.datetime(2025, 1, 1, 1)}, {"is_pickup_outside_expected_period", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
    ({"passenger_count": None}, {"has_missing_trip_attributes", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
    ({"fare_amount": -0.01, "total_amount": 0.0}, {"is_negative_fare", "is_negative_transaction", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
    ({"total_amount": -0.001}, {"is_negative_total_amount", "is_negative_transaction", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
    ({"vendor_id": 3}, {"is_unrecognized_vendor", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
    ({"vendor_id": None}, {"is_valid_for_speed_analysis"}),
    ({"ratecode_id": 99}, {"is_documented_unknown_ratecode", "has_suspicious_condition", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
    ({"payment_type": 5}, {"is_documented_unknown_payment_type", "has_suspicious_condition", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
    ({"store_and_fwd_flag": "y"}, {"is_unrecognized_store_and_fwd", "has_any_quality_flag", "is_valid_for_speed_analysis"}),
]


@pytest.mark.parametrize("change,flags", CASES)
def test_flags(spark, change, flags):
    t = stage(spark, **change)
    assert t.columns == STAGING_COLUMNS
    row = t.first().asDict()
    assert {f for f in FLAGS if row[f]} == flags
    assert all(row[f] is not None for f in FLAGS)


def test_speed_and_no_average_without_rows(spark):
    assert stage(spark).first().average_speed_mph == 10.0
    row = daily_metrics(stage(spark, trip_distance=-1.0)).first()
    assert row.trip_count == 1 and row.average_trip_distance is None and row.average_speed_mph is None and row.net_total_amount == 1
