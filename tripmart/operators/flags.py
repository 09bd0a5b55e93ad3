"""Quality flags: one boolean a rule, FALSE where a comparison is NULL. No row is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trips import month_start
from ..schema import FLAGS, PAYMENTS, RATECODES, STORE_AND_FWD, UNKNOWN_PAYMENT, UNKNOWN_RATECODE, VENDORS

DAY = "INTERVAL '24' HOUR"


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def basic_flags() -> dict[str, Column]:
    """Flags on single rules; money is compared as read, before it becomes decimal."""
    pickup, dropoff, distance = F.col("pickup_datetime"), F.col("dropoff_datetime"), F.col("trip_distance")
    start = month_start(F.col("period_year"), F.col("period_month"))
    fare, total = F.col("fare_amount").cast("double"), F.col("total_amount").cast("double")
    outside = lambda name, codes: _sure(~F.col(name).isin(*codes))
    return {
        "has_missing_datetime": pickup.isNull() | dropoff.isNull(),
        "is_nonpositive_duration": _sure(dropoff <= pickup),
        "is_duration_over_24_hours": _sure(dropoff - pickup > F.expr(DAY)),
        "is_negative_distance": _sure(distance < 0),
        "is_zero_distance": _sure(distance == 0),
        "is_pickup_outside_expected_period": _sure((pickup < start.cast("timestamp_ntz")) | (pickup >= F.add_months(start, 1).cast("timestamp_ntz"))),
        "has_missing_trip_attributes": F.col("passenger_count").isNull() | F.col("ratecode_id").isNull() | F.col("store_and_fwd_flag").isNull(),
        "is_negative_fare": _sure(fare < 0),
        "is_negative_total_amount": _sure(total < 0),
        "is_negative_transaction": _sure(fare < 0) | _sure(total < 0),
        "is_unrecognized_vendor": outside("vendor_id", VENDORS),
        "is_unrecognized_ratecode": outside("ratecode_id", RATECODES),
        "is_unrecognized_payment_type": outside("payment_type", PAYMENTS),
        "is_unrecognized_store_and_fwd": outside("store_and_fwd_flag", STORE_AND_FWD),
        "is_documented_unknown_ratecode": _sure(F.col("ratecode_id") == UNKNOWN_RATECODE),
        "is_documented_unknown_payment_type": _sure(F.col("payment_type") == UNKNOWN_PAYMENT),
        "is_valid_for_speed_analysis": _sure((dropoff > pickup) & (distance > 0)),
    }


def derived_flags() -> dict[str, Column]:
    """Flags that combine others."""
    any_of = lambda *names: F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    quality = [*FLAGS[:7], *FLAGS[9:16]]
    return {
        "has_operational_issue": any_of("has_missing_datetime", "is_nonpositive_duration", "is_negative_distance"),
        "has_suspicious_condition": any_of("is_duration_over_24_hours", "is_zero_distance", "is_documented_unknown_ratecode", "is_documented_unknown_payment_type"),
        "has_any_quality_flag": any_of(*quality),
    }


def with_quality_flags(t: DataFrame) -> DataFrame:
    """``t`` with the twenty flags; it needs the raw columns and period_year, period_month."""
    return t.withColumns(basic_flags()).withColumns(derived_flags())


def is_speeding(speed: Column, limit: float = 80.0) -> Column:
    """For profiling only."""
    return _sure(speed > limit)
