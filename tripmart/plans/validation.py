"""Validation and reconciliation of the layers.

A check gives violations, which must be none, or a report of differences, which
must be 0. ``CHECKS`` runs each over a ``Model``-like object with raw, log,
staging, dims, fact, daily, hourly and main, the ingestion that checks of one month take.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import code_text
from ..functions.trips import date_key, month_start
from ..operators.compare import check_grain, diff_rows, expectations, reconcile_totals, symmetric_difference
from ..operators.distinct import distinct_ids
from ..operators.measures import COUNTS
from ..operators.reconcile import mismatches, missing_keys
from ..schema import FLAGS, MISSING, MONEY_COLUMNS, PAYMENTS, RATECODES, STATUSES, STORE_AND_FWD, VENDORS
from . import analytics, marts

ADDITIVE = ["trip_count", *COUNTS, "positive_total_amount", "negative_total_amount", "net_total_amount"]
OPERATIONAL = ["ingestion_id", "pickup_datetime", "dropoff_datetime", "pickup_location_id", "dropoff_location_id", "passenger_count", "trip_distance", "trip_duration_minutes", "average_speed_mph", "loaded_at"]


def _n(name: str = "row_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def _main(m, t: DataFrame) -> DataFrame:
    """The rows of the ingestion that the model's checks of one month are about."""
    return t.where(F.col("ingestion_id") == m.main)


# staging


def raw_and_staging(raw: DataFrame, staging: DataFrame) -> DataFrame:
    return raw.agg(_n("raw_rows")).crossJoin(staging.agg(_n("staging_rows")))


def distinct_trips(staging: DataFrame) -> DataFrame:
    return distinct_ids(staging, ["ingestion_id"], "raw_trip_id", "distinct_trip_ids")


def flag_counts(staging: DataFrame) -> DataFrame:
    """All flags and calculated speeds, in one pass."""
    return staging.agg(_n("total_rows"), *[F.count_if(F.col(f)).alias(f"{f}_rows") for f in FLAGS], F.count("average_speed_mph").alias("calculated_speed_rows"))


def inconsistent_speeds(staging: DataFrame) -> DataFrame:
    return staging.where(F.col("is_valid_for_speed_analysis") != F.col("average_speed_mph").isNotNull()).agg(_n("inconsistent_speed_rows"))


def money_precision(raw: DataFrame) -> DataFrame:
    """Largest absolute values, and values of more than two decimals (of nine: beyond is noise of binary fractions)."""
    exact = lambda c: F.col(c).cast("decimal(30,9)")
    return raw.agg(*[F.max(F.abs(c)).alias(f"max_abs_{c}") for c in MONEY_COLUMNS], *[F.count_if(exact(c) != F.round(exact(c), 2)).alias(f"{c}_over_2_decimals") for c in MONEY_COLUMNS])


CODES = ["vendor_id", "ratecode_id", "payment_type", "store_and_fwd_flag"]


def code_counts(staging: DataFrame) -> DataFrame:
    """Rows by field and code in long form; the four fields are counted in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), code_text(F.col(c)).alias("field_value")) for c in CODES])
    return staging.select(F.inline(pairs)).groupBy("field_name", "field_value").agg(_n())


def unrecognized_codes(staging: DataFrame) -> DataFrame:
    rule = lambda c, codes: F.count_if(~F.col(c).isin(*codes))
    return staging.agg(
        rule("vendor_id", VENDORS).alias("unrecognized_vendor_rows"),
        rule("ratecode_id", RATECODES).alias("unrecognized_ratecode_rows"),
        rule("payment_type", PAYMENTS).alias("unrecognized_payment_type_rows"),
        rule("store_and_fwd_flag", STORE_AND_FWD).alias("unrecognized_store_and_fwd_rows"),
    )


# analytics


def daily_ranges(daily: DataFrame) -> DataFrame:
    return daily.groupBy("ingestion_id").agg(_n("daily_row_count"), F.count_distinct("pickup_date").alias("distinct_pickup_dates"), F.sum("trip_count").alias("represented_trip_count"), F.min("pickup_date").alias("first_pickup_date"), F.max("pickup_date").alias("last_pickup_date"))


def hourly_ranges(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("ingestion_id").agg(
        _n("hourly_row_count"), F.count_distinct(F.struct("pickup_date", "pickup_hour")).alias("distinct_date_hours"), F.count_distinct("pickup_date").alias("represented_days"),
        F.count_distinct("pickup_hour").alias("represented_hours"), F.sum("trip_count").alias("represented_trip_count"), F.min("pickup_date").alias("first_pickup_date"),
        F.max("pickup_date").alias("last_pickup_date"), F.min("pickup_hour").alias("first_pickup_hour"), F.max("pickup_hour").alias("last_pickup_hour"),
    )


def staging_totals(eligible: DataFrame) -> DataFrame:
    total = F.col("total_amount")
    amount = lambda keep: F.coalesce(F.sum(F.when(keep, total)), F.lit(0)).cast("decimal(18,2)")
    return eligible.groupBy("ingestion_id").agg(_n("trip_count"), *[F.count_if(F.col(f)).alias(c) for c, f in COUNTS.items()], amount(total > 0).alias("positive_total_amount"), amount(total < 0).alias("negative_total_amount"), amount(F.lit(True)).alias("net_total_amount"))


def metric_totals(t: DataFrame) -> DataFrame:
    kinds = dict(t.dtypes)
    return t.groupBy("ingestion_id").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in ADDITIVE])


def broken_identity(t: DataFrame, keys: list[str]) -> DataFrame:
    return t.where(F.col("positive_total_amount") + F.col("negative_total_amount") != F.col("net_total_amount")).select(*keys, "positive_total_amount", "negative_total_amount", "net_total_amount")


def _outside_month() -> Column:
    start = month_start(F.col("period_year"), F.col("period_month"))
    return (F.col("pickup_date") < start) | (F.col("pickup_date") >= F.add_months(start, 1))


def outside_month(t: DataFrame) -> DataFrame:
    return t.where(_outside_month()).select("ingestion_id", "period_year", "period_month", "pickup_date")


def invalid_hours(t: DataFrame) -> DataFrame:
    return t.where(~F.col("pickup_hour").between(0, 23) | _outside_month()).select("ingestion_id", "period_year", "period_month", "pickup_date", "pickup_hour")


def hourly_against_daily(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    rolled = analytics.hourly_rolled_up(hourly)
    columns = [c for c in rolled.columns if c not in ("ingestion_id", "pickup_date", "total_trip_distance")]  # hours' distances are rounded each
    return diff_rows(daily.select("ingestion_id", "pickup_date", *columns), rolled.select("ingestion_id", "pickup_date", *columns), ["ingestion_id", "pickup_date"], columns)


# marts

DAILY_WINDOWS = ["previous_day_trip_count", "daily_trip_count_change", "daily_trip_count_change_percentage", "cumulative_trip_count", "cumulative_net_total_amount", "rolling_7_day_average_trip_count", "trip_demand_rank", "period_trip_share_percentage"]


def mart_ranges(mart: DataFrame, key: str, name: str) -> DataFrame:
    return mart.groupBy("ingestion_id").agg(_n("mart_row_count"), F.count_distinct(key).alias(f"distinct_{name}"), F.sum("trip_count").alias("represented_trip_count"), F.min(key).alias(f"first_{key}"), F.max(key).alias(f"last_{key}"))


def daily_windows(mart: DataFrame) -> DataFrame:
    """Rows whose window columns differ from windows over their own counts."""
    again = marts.daily_summary(mart.select(*analytics.DAILY_COLUMNS))
    return diff_rows(again, mart, ["ingestion_id", "pickup_date"], DAILY_WINDOWS)


def daily_final(mart: DataFrame) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("ingestion_id").orderBy(F.desc("pickup_date")))
    final = mart.withColumn("__last", last).where("__last = 1").select("ingestion_id", F.col("pickup_date").alias("final_pickup_date"), "cumulative_trip_count", "cumulative_net_total_amount")
    totals = mart.groupBy("ingestion_id").agg(F.sum("trip_count").alias("expected_final_trip_count"), F.sum("net_total_amount").cast("decimal(18,2)").alias("expected_final_net_total_amount"), F.sum("period_trip_share_percentage").cast("decimal(12,4)").alias("rounded_period_trip_share_percentage"))
    return final.join(totals, "ingestion_id")


def daily_known(mart: DataFrame, last_day: str = "2024-01-30") -> DataFrame:
    at = F.col("pickup_date") == F.lit(last_day).cast("date")
    return mart.groupBy("ingestion_id").agg(
        _n("represented_days"), F.sum("trip_count").alias("represented_trips"), F.max(F.when(at, F.col("cumulative_trip_count"))).alias("final_cumulative_trip_count"),
        F.max(F.when(at, F.col("cumulative_net_total_amount"))).alias("final_cumulative_net_total_amount"), F.min("trip_demand_rank").alias("best_demand_rank"), F.max("trip_demand_rank").alias("lowest_demand_rank"),
    )


def profile_against_hourly(profile: DataFrame, hourly: DataFrame) -> DataFrame:
    columns = ["represented_day_count", *ADDITIVE]
    return diff_rows(marts.hourly_totals(hourly), profile, ["ingestion_id", "pickup_hour"], columns)


def profile_windows(profile: DataFrame, hourly: DataFrame) -> DataFrame:
    again = marts.hourly_profile(hourly)
    return diff_rows(again, profile, ["ingestion_id", "pickup_hour"], [c for c in profile.columns if c not in ("ingestion_id", "pickup_hour")])


def invalid_percentages(profile: DataFrame) -> DataFrame:
    names = [c for c in profile.columns if c.endswith("_percentage") and "change" not in c]
    bad = reduce(lambda a, b: a | b, [~F.col(c).between(0, 100) for c in names], F.col("positive_total_amount") + F.col("negative_total_amount") != F.col("net_total_amount"))
    return profile.where(bad).select("ingestion_id", "pickup_hour")


def hourly_final(profile: DataFrame) -> DataFrame:
    return profile.groupBy("ingestion_id").agg(
        _n("represented_hours"), F.sum("trip_count").alias("represented_trips"), F.max(F.when(F.col("pickup_hour") == 23, F.col("cumulative_trip_count"))).alias("final_cumulative_trip_count"),
        F.sum("net_total_amount").cast("decimal(18,2)").alias("expected_net_total_amount"), F.sum("period_trip_share_percentage").cast("decimal(12,4)").alias("rounded_period_trip_share_percentage"),
        F.min("demand_rank").alias("best_demand_rank"), F.max("demand_rank").alias("lowest_demand_rank"), F.max(F.when(F.col("demand_rank") == 1, F.col("pickup_hour"))).alias("highest_demand_hour"),
        F.max(F.when(F.col("demand_rank") == 1, F.col("trip_count"))).alias("highest_demand_trip_count"),
    )


# star


def object_counts(dims: dict[str, DataFrame], fact: DataFrame) -> DataFrame:
    parts = [t.agg(_n()).select(F.lit(name).alias("object_name"), "row_count") for name, t in (dims | {"fact_trip": fact}).items()]
    return reduce(DataFrame.unionByName, parts)


def fact_grain(fact: DataFrame) -> DataFrame:
    counts = distinct_ids(fact, [], "raw_trip_id", "distinct_trip_ids")
    return counts.withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_trip_ids"))


def fact_coverage(staging: DataFrame, fact: DataFrame) -> DataFrame:
    count = lambda t: t.groupBy("ingestion_id").agg(_n("trip_count"))
    return reconcile_totals(count(staging), count(fact), ["ingestion_id"], ["trip_count"], fill=True).select("ingestion_id", "trip_count_difference")


def fact_ids(staging: DataFrame, fact: DataFrame) -> DataFrame:
    return missing_keys(staging, fact, "raw_trip_id", "missing_from_fact", "additional_in_fact")


FOREIGN_KEYS = {
    "ingestion_id": ("dim_ingestion", "ingestion_id"), "pickup_date_key": ("dim_date", "date_key"), "dropoff_date_key": ("dim_date", "date_key"),
    "pickup_hour_key": ("dim_hour", "hour_key"), "dropoff_hour_key": ("dim_hour", "hour_key"), "vendor_key": ("dim_vendor", "vendor_key"),
    "rate_code_key": ("dim_rate_code", "rate_code_key"), "payment_type_key": ("dim_payment_type", "payment_type_key"), "store_and_fwd_key": ("dim_store_and_fwd", "store_and_fwd_key"),
}


def foreign_key_orphans(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Orphans of nine keys, from one pass with nine joins to small tables."""
    t = fact.select(*FOREIGN_KEYS)
    for key, (dim, parent) in FOREIGN_KEYS.items():
        t = t.join(dims[dim].select(F.col(parent).alias(f"__{key}")), F.col(key) == F.col(f"__{key}"), "left")
    return t.agg(*[F.count_if(F.col(f"__{key}").isNull()).alias(f"{key}_orphans") for key in FOREIGN_KEYS])


def audit_against_dim(log: DataFrame, dim: DataFrame) -> DataFrame:
    expected = log.withColumnRenamed("status", "ingestion_status")
    return diff_rows(expected, dim, ["ingestion_id"], [c for c in dim.columns if c != "ingestion_id"])


def date_ranges(dim: DataFrame) -> DataFrame:
    return dim.agg(F.min("full_date").alias("minimum_date"), F.max("full_date").alias("maximum_date"), _n("date_count"), F.count_distinct("date_key").alias("distinct_date_key_count"), F.count_distinct("full_date").alias("distinct_full_date_count"))


def wrong_dates(dim: DataFrame) -> DataFrame:
    d = F.col("full_date")
    bad = (F.col("date_key") != date_key(d)) | (F.col("calendar_year") != F.year(d)) | (F.col("calendar_quarter") != F.quarter(d)) | (F.col("month_number") != F.month(d))
    bad |= (F.col("day_of_month") != F.dayofmonth(d)) | (F.col("day_of_week") != F.weekday(d) + 1) | (F.col("iso_week") != F.weekofyear(d)) | (F.col("is_weekend") != (F.weekday(d) >= 5))
    return dim.where(bad).select("date_key", "full_date")


def missing_dates(staging: DataFrame, dim: DataFrame) -> DataFrame:
    """Days of trips that the dimension lacks; a null timestamp shows as a null day."""
    days = staging.select(F.to_date("pickup_datetime").alias("full_date")).union(staging.select(F.to_date("dropoff_datetime"))).distinct()
    return days.join(dim.select("full_date"), "full_date", "left_anti")


def hour_ranges(dim: DataFrame) -> DataFrame:
    return dim.agg(F.min("hour_key").cast("int").alias("minimum_hour"), F.max("hour_key").cast("int").alias("maximum_hour"), _n("hour_count"), F.count_distinct("hour_key").alias("distinct_hour_count"))


def missing_hours(dim: DataFrame) -> DataFrame:
    return dim.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_key")).join(dim.select(F.col("hour_key").cast("int").alias("hour_key")), "hour_key", "left_anti")


def categorical_differences(staging: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Members that stand in staging or in the dimension only, by dimension."""
    expected = {
        "dim_vendor": staging.where("vendor_id IS NOT NULL").select("vendor_id", "vendor_name", "is_unrecognized_vendor"),
        "dim_rate_code": staging.select("ratecode_id", F.coalesce("ratecode_name", F.lit(MISSING)), "is_unrecognized_ratecode", "is_documented_unknown_ratecode", F.col("ratecode_id").isNull()),
        "dim_payment_type": staging.where("payment_type IS NOT NULL").select("payment_type", "payment_type_name", "is_unrecognized_payment_type", "is_documented_unknown_payment_type"),
        "dim_store_and_fwd": staging.select("store_and_fwd_flag", F.coalesce("store_and_fwd_description", F.lit(MISSING)), "is_unrecognized_store_and_fwd", F.col("store_and_fwd_flag").isNull()),
    }
    parts = []
    for name, want in expected.items():
        have = dims[name].select(*dims[name].columns[1:])
        parts.append(symmetric_difference(want.toDF(*have.columns).distinct(), have).agg(_n("difference_count")).select(F.lit(name).alias("dimension_name"), "difference_count"))
    return reduce(DataFrame.unionByName, parts)


def key_derivation(staging: DataFrame, fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Keys of the fact that don't lead back to what staging has."""
    f = fact.select("raw_trip_id", *FOREIGN_KEYS).withColumnRenamed("ingestion_id", "f_ingestion_id")
    t = staging.join(f, "raw_trip_id")
    for key, dim, parent, code in (("vendor_key", "dim_vendor", "vendor_key", "vendor_id"), ("rate_code_key", "dim_rate_code", "rate_code_key", "ratecode_id"), ("payment_type_key", "dim_payment_type", "payment_type_key", "payment_type"), ("store_and_fwd_key", "dim_store_and_fwd", "store_and_fwd_key", "store_and_fwd_flag")):
        t = t.join(dims[dim].select(F.col(parent).alias(key), F.col(code).alias(f"__{code}")), key)
    differ = lambda a, b: F.count_if(~a.eqNullSafe(b))
    pickup, dropoff = F.col("pickup_datetime"), F.col("dropoff_datetime")
    return t.agg(
        differ(F.col("pickup_date_key"), date_key(F.to_date(pickup))).alias("pickup_date_key_mismatches"), differ(F.col("dropoff_date_key"), date_key(F.to_date(dropoff))).alias("dropoff_date_key_mismatches"),
        differ(F.col("pickup_hour_key").cast("int"), F.hour(pickup)).alias("pickup_hour_key_mismatches"), differ(F.col("dropoff_hour_key").cast("int"), F.hour(dropoff)).alias("dropoff_hour_key_mismatches"),
        differ(F.col("__vendor_id"), F.col("vendor_id")).alias("vendor_key_mismatches"), differ(F.col("__ratecode_id"), F.col("ratecode_id")).alias("rate_code_key_mismatches"),
        differ(F.col("__payment_type"), F.col("payment_type")).alias("payment_type_key_mismatches"), differ(F.col("__store_and_fwd_flag"), F.col("store_and_fwd_flag")).alias("store_and_fwd_key_mismatches"),
    )


def preserved_columns(staging: DataFrame, fact: DataFrame) -> DataFrame:
    """Mismatches of forty columns between staging and fact, in long form; only buckets of trips that differ are joined."""
    return mismatches(staging, fact, "raw_trip_id", [*OPERATIONAL, *MONEY_COLUMNS, *FLAGS])


def monetary_differences(staging: DataFrame, fact: DataFrame) -> DataFrame:
    """Fact minus staging, ten sums by ingestion; an ingestion that the fact lacks is not shown."""
    sums = lambda t: t.groupBy("ingestion_id").agg(*[F.sum(c).alias(c) for c in MONEY_COLUMNS])
    s, f = sums(staging).alias("s"), sums(fact).alias("f")
    return s.join(f, "ingestion_id").select("ingestion_id", *[(F.col(f"f.{c}") - F.col(f"s.{c}")).cast("decimal(18,2)").alias(f"{c}_difference") for c in MONEY_COLUMNS])


def verify_ingestion(manifest: DataFrame, log: DataFrame, raw: DataFrame, source_file_name: str, file_size_bytes: int, ingestion_id: int | None) -> DataFrame:
    """Seven named checks of one completed ingestion against its file; an error where there is none."""
    if ingestion_id is None:
        raise ValueError("No matching completed ingestion was found.")
    run = log.where(F.col("ingestion_id") == ingestion_id)
    stored = raw.where(F.col("ingestion_id") == ingestion_id).agg(_n("stored"))
    row = run.crossJoin(manifest.agg(F.sum("rows").alias("rows"))).crossJoin(stored)
    checks = {
        "ingestion status is completed": F.col("status") == "completed",
        "source file name matches": F.col("source_file_name") == source_file_name,
        "source file size matches": F.col("file_size_bytes") == file_size_bytes,
        "Parquet rows match rows_read": F.col("rows") == F.col("rows_read"),
        "rows_read match rows_loaded": F.col("rows_read") == F.col("rows_loaded"),
        "rows_loaded match stored count": F.col("rows_loaded") == F.col("stored"),
        "rows_rejected is zero": F.col("rows_rejected") == 0,
    }
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), c.alias("passed")) for k, c in checks.items()])))


def constraint_violations(raw: DataFrame, log: DataFrame, dims: dict[str, DataFrame], fact: DataFrame) -> DataFrame:
    """Declared constraints as counts of rows that break them."""
    c = F.col
    log_rules = {
        "log_year_in_range": c("period_year").between(2000, 2100), "log_month_in_range": c("period_month").between(1, 12), "log_size_not_negative": c("file_size_bytes") >= 0,
        "log_status_known": c("status").isin(*STATUSES), "log_counts_not_negative": (c("rows_read") >= 0) & (c("rows_loaded") >= 0) & (c("rows_rejected") >= 0),
    }
    fact_rules = {
        "fact_pickup_location_positive": c("pickup_location_id") > 0, "fact_dropoff_location_positive": c("dropoff_location_id") > 0,
        "fact_timestamps_present": c("pickup_datetime").isNotNull() & c("dropoff_datetime").isNotNull(), "fact_vendor_present": c("vendor_key").isNotNull(),
    }
    parts = [
        expectations(log, log_rules),
        expectations(raw, {"raw_trip_id_present": c("raw_trip_id").isNotNull(), "raw_ingestion_id_present": c("ingestion_id").isNotNull()}),
        expectations(fact, fact_rules),
        expectations(dims["dim_date"], {"date_month_in_range": c("month_number").between(1, 12), "date_day_in_range": c("day_of_month").between(1, 31), "date_weekday_in_range": c("day_of_week").between(1, 7), "date_week_in_range": c("iso_week").between(1, 53)}),
        expectations(dims["dim_hour"], {"hour_in_range": c("hour_key").between(0, 23), "hour_period_known": c("day_period").isin("Night", "Morning", "Afternoon", "Evening")}),
        expectations(dims["dim_rate_code"], {"rate_code_missing_means_null": c("is_missing") == c("ratecode_id").isNull()}),
        expectations(dims["dim_store_and_fwd"], {"flag_missing_means_null": c("is_missing") == c("store_and_fwd_flag").isNull()}),
    ]
    for name, key in (("dim_vendor", "vendor_id"), ("dim_rate_code", "ratecode_id"), ("dim_payment_type", "payment_type"), ("dim_store_and_fwd", "store_and_fwd_flag"), ("dim_ingestion", "ingestion_id"), ("dim_date", "full_date")):
        parts.append(check_grain(dims[name], [key]).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{name}_unique").alias("check_name"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def _daily_mart(m):
    return marts.daily_summary(m.fact_daily())


def _hourly_mart(m):
    return marts.hourly_profile(m.fact_hourly())


def _grain_report(m):
    """Keys with several rows in each layer."""
    layers = {"daily": (m.daily, ["ingestion_id", "pickup_date"]), "hourly": (m.hourly, ["ingestion_id", "pickup_date", "pickup_hour"]), "daily_mart": (_daily_mart(m), ["ingestion_id", "pickup_date"]), "hourly_mart": (_hourly_mart(m), ["ingestion_id", "pickup_hour"]), "fact": (m.fact, ["raw_trip_id"])}
    return reduce(DataFrame.unionByName, [check_grain(t, keys).agg(_n("violations")).select(F.lit(k).alias("layer"), "violations") for k, (t, keys) in layers.items()])


CHECKS = {
    "v01_raw_and_staging": lambda m: raw_and_staging(m.raw, m.staging),
    "v02_distinct_trips": lambda m: distinct_trips(m.staging),
    "v03_flag_counts": lambda m: flag_counts(_main(m, m.staging)),
    "v04_inconsistent_speeds": lambda m: inconsistent_speeds(_main(m, m.staging)),
    "v05_money_precision": lambda m: money_precision(_main(m, m.raw)),
    "v06_code_counts": lambda m: code_counts(_main(m, m.staging)),
    "v06_unrecognized_codes": lambda m: unrecognized_codes(_main(m, m.staging)),
    "v07_daily_ranges": lambda m: daily_ranges(m.daily),
    "v08_grain": _grain_report,
    "v09_daily_reconciliation": lambda m: reconcile_totals(staging_totals(analytics.eligible_daily(m.staging)), metric_totals(m.daily), ["ingestion_id"], ADDITIVE),
    "v10_monetary_identity": lambda m: broken_identity(m.daily, ["ingestion_id", "pickup_date"]),
    "v11_outside_month": lambda m: outside_month(m.daily),
    "v12_known_daily": lambda m: daily_ranges(_main(m, m.daily)),
    "v13_hourly_ranges": lambda m: hourly_ranges(m.hourly),
    "v14_hourly_reconciliation": lambda m: reconcile_totals(staging_totals(analytics.eligible_hourly(m.staging)), metric_totals(m.hourly), ["ingestion_id"], ADDITIVE),
    "v15_hourly_against_daily": lambda m: hourly_against_daily(m.hourly, m.daily),
    "v16_invalid_hours": lambda m: invalid_hours(m.hourly),
    "v17_known_hourly": lambda m: hourly_ranges(_main(m, m.hourly)),
    "v18_daily_mart_ranges": lambda m: mart_ranges(_daily_mart(m), "pickup_date", "pickup_dates"),
    "v19_daily_mart_totals": lambda m: reconcile_totals(metric_totals(m.daily), metric_totals(_daily_mart(m)), ["ingestion_id"], ADDITIVE),
    "v20_daily_mart_windows": lambda m: daily_windows(_daily_mart(m)),
    "v21_daily_mart_final": lambda m: daily_final(_daily_mart(m)),
    "v22_known_daily_mart": lambda m: daily_known(_main(m, _daily_mart(m))),
    "v23_hourly_mart_ranges": lambda m: mart_ranges(_hourly_mart(m), "pickup_hour", "pickup_hours"),
    "v24_hourly_mart_totals": lambda m: profile_against_hourly(_hourly_mart(m), m.hourly),
    "v25_hourly_mart_windows": lambda m: profile_windows(_hourly_mart(m), m.hourly),
    "v26_invalid_percentages": lambda m: invalid_percentages(_hourly_mart(m)),
    "v27_hourly_mart_final": lambda m: hourly_final(_hourly_mart(m)),
    "v28_object_counts": lambda m: object_counts(m.dims, m.fact),
    "v29_fact_grain": lambda m: fact_grain(m.fact),
    "v30_fact_coverage": lambda m: fact_coverage(m.staging, m.fact),
    "v31_fact_ids": lambda m: fact_ids(m.staging, m.fact),
    "v32_foreign_key_orphans": lambda m: foreign_key_orphans(m.fact, m.dims),
    "v33_audit_against_dim": lambda m: audit_against_dim(m.log, m.dims["dim_ingestion"]),
    "v34_date_ranges": lambda m: date_ranges(m.dims["dim_date"]),
    "v34_wrong_dates": lambda m: wrong_dates(m.dims["dim_date"]),
    "v34_missing_dates": lambda m: missing_dates(m.staging, m.dims["dim_date"]),
    "v35_hour_ranges": lambda m: hour_ranges(m.dims["dim_hour"]).crossJoin(missing_hours(m.dims["dim_hour"]).agg(_n("missing_hours"))).crossJoin(m.raw.agg(F.count_distinct(F.hour("pickup_datetime")).alias("hours_of_trips"))),
    "v36_categorical_differences": lambda m: categorical_differences(m.staging, m.dims),
    "v37_key_derivation": lambda m: key_derivation(m.staging, m.fact, m.dims),
    "v38_preserved_columns": lambda m: preserved_columns(m.staging, m.fact),
    "v41_monetary_differences": lambda m: monetary_differences(m.staging, m.fact),
    "v43_constraints": lambda m: constraint_violations(m.raw, m.log, m.dims, m.fact),
}
