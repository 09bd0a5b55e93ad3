import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripmart.functions import casts, decode, trips
from tripmart.operators.prepare import prepare_raw, require_columns
from tripmart.schema import RAW_COLUMNS, SOURCE_COLUMNS

ROW = {
    "VendorID": "2", "tpep_pickup_datetime": "2025-01-01 08:15:00", "tpep_dropoff_datetime": "2025-01-01 08:30:00", "passenger_count": "1", "trip_distance": "3.5",
    "RatecodeID": "1", "store_and_fwd_flag": " \tY ", "PULocationID": "161", "DOLocationID": "236", "payment_type": "1", "fare_amount": "18.5", "extra": "2.5", "mta_tax": "0.5",
    "tip_amount": "4.0", "tolls_amount": "0", "improvement_surcharge": "1.0", "total_amount": "26.5", "congestion_surcharge": "2.5", "Airport_fee": "0", "cbd_congestion_fee": "0",
}


def source(spark, **change):
    row = ROW | change
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` string" for c in row))


def test_types_order_and_trim(spark):
    t = prepare_raw(source(spark, unexpected_column="x"))
    assert t.columns == RAW_COLUMNS
    kinds = dict(t.dtypes)
    assert kinds["vendor_id"] == "int" and kinds["pickup_datetime"] == "timestamp_ntz" and kinds["fare_amount"] == "double"
    row = t.first()
    assert row.store_and_fwd_flag == "Y" and row.vendor_id == 2 and row.trip_distance == 3.5
    assert row.pickup_datetime == dt.datetime(2025, 1, 1, 8, 15)


def test_invalid_becomes_null(spark):
    row = prepare_raw(source(spark, passenger_count="invalid", trip_distance="NaN", tpep_pickup_datetime="soon", RatecodeID="2.0", payment_type="1.5")).first()
    assert (row.passenger_count, row.trip_distance, row.pickup_datetime, row.ratecode_id, row.payment_type) == (None, None, None, 2, None)


def test_missing_columns_are_listed(spark):
    t = source(spark).drop("VendorID", "Airport_fee")
    with pytest.raises(ValueError, match="Airport_fee, VendorID"):
        require_columns(t)
    assert set(SOURCE_COLUMNS) == set(ROW)


def test_labels_codes_and_names(spark):
    t = spark.createDataFrame([(None, None), (1, ""), (5, "y"), (99, "Y")], "code int, flag string")
    rows = t.select(decode.decode_vendor(F.col("code")), decode.decode_ratecode(F.col("code")), decode.decode_store_fwd(F.col("flag")), casts.label_missing(F.col("flag")), casts.code_text(F.col("code"))).collect()
    assert [tuple(r) for r in rows] == [
        (None, None, None, "[NULL]", "NULL"),
        ("Creative Mobile Technologies, LLC", "Standard rate", "Unrecognized", "[EMPTY STRING]", "1"),
        ("Unrecognized", "Negotiated fare", "Unrecognized", "y", "5"),
        ("Unrecognized", "Unknown", "Store and forward trip", "Y", "99"),
    ]


def test_calendar(spark):
    d = F.lit("2024-12-30").cast("date")
    row = spark.range(1).select(trips.date_key(d), trips.month_name(d), trips.day_name(d), F.weekofyear(d)).first()
    assert tuple(row) == (20241230, "December", "Monday", 1)
