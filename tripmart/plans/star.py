"""The star schema: eight dimensions' rows, their upserts, and the trip fact."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trips import date_key, day_name, month_name
from ..operators.upsert import upsert
from ..schema import FLAGS, LOG, MISSING, MONEY_COLUMNS

DIM_INGESTION_COLUMNS = [f.name if f.name != "status" else "ingestion_status" for f in LOG.fields]
FACT_COLUMNS = [
    "raw_trip_id", "ingestion_id", "pickup_date_key", "dropoff_date_key", "pickup_hour_key", "dropoff_hour_key", "vendor_key", "rate_code_key",
    "payment_type_key", "store_and_fwd_key", "pickup_datetime", "dropoff_datetime", "pickup_location_id", "dropoff_location_id", "passenger_count",
    "trip_distance", "trip_duration_minutes", "average_speed_mph", *MONEY_COLUMNS, "loaded_at", *FLAGS,
]


def dim_ingestion(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return upsert(existing, log.withColumnRenamed("status", "ingestion_status").select(*DIM_INGESTION_COLUMNS), ["ingestion_id"])


def dim_date(staging: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Every day from the first to the last pickup or dropoff."""
    pickup, dropoff = F.to_date("pickup_datetime"), F.to_date("dropoff_datetime")
    bounds = staging.agg(F.least(F.min(pickup), F.min(dropoff)).alias("first"), F.greatest(F.max(pickup), F.max(dropoff)).alias("last")).where("first IS NOT NULL")
    days = bounds.select(F.explode(F.expr("sequence(first, last, INTERVAL 1 DAY)")).alias("full_date"))
    d = F.col("full_date")
    rows = days.select(
        date_key(d).alias("date_key"), "full_date", F.year(d).alias("calendar_year"), F.quarter(d).alias("calendar_quarter"), F.month(d).alias("month_number"),
        month_name(d).alias("month_name"), F.dayofmonth(d).alias("day_of_month"), (F.weekday(d) + 1).alias("day_of_week"), day_name(d).alias("day_name"),
        F.weekofyear(d).alias("iso_week"), (F.weekday(d) >= 5).alias("is_weekend"),
    )
    return upsert(existing, rows, ["date_key"])


def dim_hour(spark: SparkSession) -> DataFrame:
    h = F.col("hour_key")
    period = F.when(h.between(0, 5), "Night").when(h.between(6, 11), "Morning").when(h.between(12, 17), "Afternoon").otherwise("Evening")
    hours = spark.range(24).select(F.col("id").cast("short").alias("hour_key"))
    return hours.select("hour_key", F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00")).alias("hour_label"), period.alias("day_period"))


def dim_vendor(staging: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = staging.where("vendor_id IS NOT NULL").select("vendor_id", "vendor_name", "is_unrecognized_vendor").distinct()
    return upsert(existing, rows, ["vendor_id"], "vendor_key")


def dim_rate_code(staging: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = staging.select(
        "ratecode_id", F.coalesce("ratecode_name", F.lit(MISSING)).alias("ratecode_name"), "is_unrecognized_ratecode",
        "is_documented_unknown_ratecode", F.col("ratecode_id").isNull().alias("is_missing"),
    ).distinct()
    return upsert(existing, rows, ["ratecode_id"], "rate_code_key")


def dim_payment_type(staging: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = staging.where("payment_type IS NOT NULL").select("payment_type", "payment_type_name", "is_unrecognized_payment_type", "is_documented_unknown_payment_type").distinct()
    return upsert(existing, rows, ["payment_type"], "payment_type_key")


def dim_store_and_fwd(staging: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = staging.select(
        "store_and_fwd_flag", F.coalesce("store_and_fwd_description", F.lit(MISSING)).alias("store_and_fwd_description"),
        "is_unrecognized_store_and_fwd", F.col("store_and_fwd_flag").isNull().alias("is_missing"),
    ).distinct()
    return upsert(existing, rows, ["store_and_fwd_flag"], "store_and_fwd_key")


CODES = [
    "vendor_id", "vendor_name", "is_unrecognized_vendor", "ratecode_id", "ratecode_name", "is_unrecognized_ratecode", "is_documented_unknown_ratecode", "payment_type",
    "payment_type_name", "is_unrecognized_payment_type", "is_documented_unknown_payment_type", "store_and_fwd_flag", "store_and_fwd_description", "is_unrecognized_store_and_fwd",
]


def codes(staging: DataFrame) -> DataFrame:
    """All that dimensions take from staging, in one pass: combinations of codes by ingestion, each with its first and its last times."""
    times = ("pickup_datetime", "dropoff_datetime")
    rows = staging.groupBy("ingestion_id", *CODES).agg(*[F.array(F.min(c), F.max(c)).alias(c) for c in times])
    return rows.select("ingestion_id", *CODES, F.explode(F.arrays_zip(*times)).alias("t")).select("ingestion_id", *CODES, *[F.col(f"t.{c}") for c in times])


#: Dimensions of at most so many rows are held by the driver and sent to the trips whatever Spark estimates.
SMALL = 100_000


def held_if_small(dims: dict[str, DataFrame], codes: DataFrame) -> dict[str, DataFrame]:
    """Dimensions evaluated once, side by side, and marked for broadcast, where the written ``codes``, of which each code dimension has no more rows, are few.

    A sort-merge join would hash all trips on a handful of codes. Days and runs are held
    only if they are as few.
    """
    if codes.count() > SMALL:
        return dims

    def hold(item: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
        name, d = item
        rows = d.limit(SMALL + 1).toArrow()  # Spark plans with Arrow's rows as they are, without Python
        return name, F.broadcast(d.sparkSession.createDataFrame(rows, d.schema)) if rows.num_rows <= SMALL else d

    with ThreadPoolExecutor(len(dims)) as pool:
        return dict(pool.map(hold, dims.items()))


def hours_of_trips(hours: DataFrame, staging: DataFrame) -> DataFrame:
    """The hours with how many trips began and ended in them."""
    count = lambda c, name: staging.groupBy(F.hour(c).alias("hour_key")).agg(F.count(F.lit(1)).alias(name))
    out = hours.join(count("pickup_datetime", "pickup_count"), "hour_key", "left").join(count("dropoff_datetime", "dropoff_count"), "hour_key", "left")
    return out.select(*hours.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pickup_count", "dropoff_count")])


def dimensions(staging: DataFrame, log: DataFrame, existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All seven dimensions, merged into the existing ones."""
    old = existing or {}
    return {
        "dim_ingestion": dim_ingestion(log, old.get("dim_ingestion")),
        "dim_date": dim_date(staging, old.get("dim_date")),
        "dim_hour": dim_hour(staging.sparkSession),
        "dim_vendor": dim_vendor(staging, old.get("dim_vendor")),
        "dim_rate_code": dim_rate_code(staging, old.get("dim_rate_code")),
        "dim_payment_type": dim_payment_type(staging, old.get("dim_payment_type")),
        "dim_store_and_fwd": dim_store_and_fwd(staging, old.get("dim_store_and_fwd")),
    }


def fact_trip(staging: DataFrame, dims: dict[str, DataFrame], existing: DataFrame | None = None) -> DataFrame:
    """Trips with the keys of their dimensions; rows without a match in one of them are left out.

    Dimensions hold a row per code, hour or day. Where they are written tables, or
    come from ``held_if_small``, Spark knows that and does not shuffle the trips.
    """
    t = staging.withColumns({"__pickup": F.to_date("pickup_datetime"), "__dropoff": F.to_date("dropoff_datetime"), "__pickup_hour": F.hour("pickup_datetime").cast("short"), "__dropoff_hour": F.hour("dropoff_datetime").cast("short")})
    t = t.join(dims["dim_ingestion"].select("ingestion_id"), "ingestion_id")
    for side in ("pickup", "dropoff"):
        t = t.join(dims["dim_date"].select(F.col("date_key").alias(f"{side}_date_key"), F.col("full_date").alias(f"__{side}")), f"__{side}")
        t = t.join(dims["dim_hour"].select(F.col("hour_key").alias(f"{side}_hour_key"), F.col("hour_key").alias(f"__{side}_hour")), f"__{side}_hour")
    t = t.join(dims["dim_vendor"].select("vendor_key", "vendor_id"), "vendor_id").join(dims["dim_payment_type"].select("payment_type_key", "payment_type"), "payment_type")
    for name, key, code in (("dim_rate_code", "rate_code_key", "ratecode_id"), ("dim_store_and_fwd", "store_and_fwd_key", "store_and_fwd_flag")):
        t = t.join(dims[name].select(key, F.col(code).alias("__code")), F.col(code).eqNullSafe(F.col("__code"))).drop("__code")
    return upsert(existing, t.select(*FACT_COLUMNS), ["raw_trip_id"])


def model_summary(fact: DataFrame, runs: DataFrame) -> DataFrame:
    """Per ingestion: trips, pickup range and amount."""
    sums = fact.groupBy("ingestion_id").agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.min("pickup_datetime").alias("minimum_pickup_datetime"),
        F.max("pickup_datetime").alias("maximum_pickup_datetime"),
        F.sum("total_amount").alias("total_amount"),
    )
    return runs.select("ingestion_id", "source_file_name", "ingestion_status").join(sums, "ingestion_id")
