"""DuckDB SQL for the registered queries of the trip warehouse."""

from __future__ import annotations

from .plans import analytics, validation
from .queries import RUNS, TRIPS_SQL
from .schema import DOUBLE_COLUMNS, FLAGS, MISSING, MONEY_COLUMNS, PAYMENTS, RATECODES, RAW_COLUMNS, STORE_AND_FWD, TIMESTAMP_COLUMNS, UNRECOGNIZED, VENDORS

COUNTS = {"operational_issue_trip_count": "has_operational_issue", "suspicious_condition_trip_count": "has_suspicious_condition", "any_quality_flag_trip_count": "has_any_quality_flag", "negative_transaction_trip_count": "is_negative_transaction", "valid_speed_trip_count": "is_valid_for_speed_analysis"}
KEYS = "ingestion_id, source_file_name, taxi_type, period_year, period_month"


def _ratio(n: str, d: str, digits: int, kind: str) -> str:
    """n / d for whole numbers n and d > 0, rounded half away from zero in whole-number arithmetic."""
    ten = 10**digits
    return f"CAST((CASE WHEN ({n}) < 0 THEN -1 ELSE 1 END) * ((2 * {ten} * abs({n}) + ({d})) // (2 * ({d}))) AS DECIMAL(24,0)) * CAST({1 / ten:.{digits}f} AS DECIMAL({digits + 1},{digits}))".join([f"CAST(CASE WHEN ({d}) > 0 THEN ", f" END AS {kind})"])


def _mean_exact(value: str, keep: str) -> str:
    kept = f"CASE WHEN {keep} THEN CAST({value} AS DECIMAL(20,8)) END"
    return _ratio(f"CAST(sum({kept}) * 100000000 AS HUGEINT)", f"CAST(count({kept}) AS HUGEINT) * 100000000", 2, "DECIMAL(12,2)")


def _mean_money(value: str) -> str:
    return _ratio(f"CAST(sum({value}) * 100 AS HUGEINT)", f"CAST(count({value}) AS HUGEINT) * 100", 2, "DECIMAL(12,2)")


def _case(column: str, names: dict) -> str:
    whens = " ".join(f"WHEN {column} = {code!r} THEN '{name}'" for code, name in names.items())
    return f"CASE WHEN {column} IS NULL THEN NULL {whens} ELSE '{UNRECOGNIZED}' END"


def _list(codes) -> str:
    return "(" + ", ".join(repr(c) for c in codes) + ")"


_START = "make_date(period_year, period_month, 1)"
_FLAG_SQL = {
    "has_missing_datetime": "pickup_datetime IS NULL OR dropoff_datetime IS NULL",
    "is_nonpositive_duration": "coalesce(dropoff_datetime <= pickup_datetime, false)",
    "is_duration_over_24_hours": "coalesce(dropoff_datetime - pickup_datetime > INTERVAL '24' HOUR, false)",
    "is_negative_distance": "coalesce(trip_distance < 0, false)",
    "is_zero_distance": "coalesce(trip_distance = 0, false)",
    "is_pickup_outside_expected_period": f"coalesce(pickup_datetime < {_START} OR pickup_datetime >= {_START} + INTERVAL '1' MONTH, false)",
    "has_missing_trip_attributes": "passenger_count IS NULL OR ratecode_id IS NULL OR store_and_fwd_flag IS NULL",
    "is_negative_fare": "coalesce(fare_amount < 0, false)",
    "is_negative_total_amount": "coalesce(total_amount < 0, false)",
    "is_negative_transaction": "coalesce(fare_amount < 0, false) OR coalesce(total_amount < 0, false)",
    "is_unrecognized_vendor": f"coalesce(vendor_id NOT IN {_list(VENDORS)}, false)",
    "is_unrecognized_ratecode": f"coalesce(ratecode_id NOT IN {_list(RATECODES)}, false)",
    "is_unrecognized_payment_type": f"coalesce(payment_type NOT IN {_list(PAYMENTS)}, false)",
    "is_unrecognized_store_and_fwd": f"coalesce(store_and_fwd_flag NOT IN {_list(STORE_AND_FWD)}, false)",
    "is_documented_unknown_ratecode": "coalesce(ratecode_id = 99, false)",
    "is_documented_unknown_payment_type": "coalesce(payment_type = 5, false)",
    "is_valid_for_speed_analysis": "coalesce(dropoff_datetime > pickup_datetime AND trip_distance > 0, false)",
}
_FLAG_SQL["has_operational_issue"] = " OR ".join(f"({_FLAG_SQL[f]})" for f in ("has_missing_datetime", "is_nonpositive_duration", "is_negative_distance"))
_FLAG_SQL["has_suspicious_condition"] = " OR ".join(f"({_FLAG_SQL[f]})" for f in ("is_duration_over_24_hours", "is_zero_distance", "is_documented_unknown_ratecode", "is_documented_unknown_payment_type"))
_FLAG_SQL["has_any_quality_flag"] = " OR ".join(f"({_FLAG_SQL[f]})" for f in [*FLAGS[:7], *FLAGS[9:16]])

_RUNS = ", ".join(f"({i}, '{name}', '{status}', {'NULL' if error is None else repr(error)})" for i, name, status, error in RUNS)
_SECONDS = "(epoch_us(dropoff_datetime) - epoch_us(pickup_datetime)) / 1000000.0::DOUBLE"
_AT = "TIMESTAMP '2024-02-01 00:00:00'"

_MEASURES = ",\n  ".join(
    [
        "count(*) AS trip_count",
        *[f"count(*) FILTER ({flag}) AS {name}" for name, flag in COUNTS.items()],
        "CAST(sum(CASE WHEN trip_distance >= 0 THEN CAST(trip_distance AS DECIMAL(20,8)) END) AS DECIMAL(18,2)) AS total_trip_distance",
        _mean_exact("trip_distance", "trip_distance >= 0") + " AS average_trip_distance",
        _mean_exact("trip_duration_minutes", "NOT has_operational_issue AND trip_duration_minutes <= 1440") + " AS average_trip_duration_minutes",
        _mean_exact("average_speed_mph", "is_valid_for_speed_analysis") + " AS average_speed_mph",
        "CAST(coalesce(sum(total_amount) FILTER (total_amount > 0), 0) AS DECIMAL(18,2)) AS positive_total_amount",
        "CAST(coalesce(sum(total_amount) FILTER (total_amount < 0), 0) AS DECIMAL(18,2)) AS negative_total_amount",
        "CAST(coalesce(sum(total_amount), 0) AS DECIMAL(18,2)) AS net_total_amount",
        _mean_money("total_amount") + " AS average_total_amount",
    ]
)
_HUGE = "CAST({} AS HUGEINT)".format


def _change(before: str) -> str:
    return f"CASE WHEN {before} > 0 THEN {_ratio(f'(CAST(trip_count AS HUGEINT) - {before}) * 100', before, 2, 'DECIMAL(12,2)')} END"


def _rolling(order: str, rows: int) -> str:
    frame = f"OVER (PARTITION BY ingestion_id ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return _ratio(f"CAST(sum(trip_count) {frame} AS HUGEINT)", f"count(trip_count) {frame}", 2, "DECIMAL(12,2)")


def _daily_summary(source: str) -> str:
    w = "(PARTITION BY ingestion_id ORDER BY pickup_date)"
    return f"""
SELECT {", ".join(analytics.DAILY_COLUMNS)}, previous AS previous_day_trip_count, trip_count - previous AS daily_trip_count_change, {_change("previous")} AS daily_trip_count_change_percentage,
  CAST(sum(trip_count) OVER (PARTITION BY ingestion_id ORDER BY pickup_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_trip_count,
  CAST(sum(net_total_amount) OVER (PARTITION BY ingestion_id ORDER BY pickup_date ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS cumulative_net_total_amount,
  {_rolling("pickup_date", 7)} AS rolling_7_day_average_trip_count, rank() OVER (PARTITION BY ingestion_id ORDER BY trip_count DESC) AS trip_demand_rank,
  {_ratio("CAST(trip_count AS HUGEINT) * 100", "CAST(sum(trip_count) OVER (PARTITION BY ingestion_id) AS HUGEINT)", 4, "DECIMAL(8,4)")} AS period_trip_share_percentage
FROM (SELECT *, lag(trip_count) OVER {w} AS previous FROM {source})"""


_HOURLY_TOTALS = f"""
SELECT {KEYS}, pickup_hour, count(DISTINCT pickup_date) AS represented_day_count, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("trip_count", *COUNTS))},
  {", ".join(f"CAST(sum({c}) AS DECIMAL(18,2)) AS {c}" for c in ("positive_total_amount", "negative_total_amount", "net_total_amount"))}
FROM hourly GROUP BY {KEYS}, pickup_hour"""

_PROFILE = f"""
SELECT {KEYS}, pickup_hour, represented_day_count, trip_count, {_ratio("CAST(trip_count AS HUGEINT)", "represented_day_count", 2, "DECIMAL(12,2)")} AS average_daily_trip_count, {", ".join(COUNTS)},
  {", ".join(_ratio(f"CAST({c} AS HUGEINT) * 100", "trip_count", 4, "DECIMAL(8,4)") + f" AS {c.replace('_trip_count', '_percentage')}" for c in list(COUNTS)[:4])},
  positive_total_amount, negative_total_amount, net_total_amount, {_ratio("CAST(net_total_amount * 100 AS HUGEINT)", "trip_count * 100", 2, "DECIMAL(12,2)")} AS average_net_total_amount_per_trip,
  previous AS previous_hour_trip_count, trip_count - previous AS hourly_trip_count_change, {_change("previous")} AS hourly_trip_count_change_percentage,
  CAST(sum(trip_count) OVER (PARTITION BY ingestion_id ORDER BY pickup_hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_trip_count,
  {_rolling("pickup_hour", 3)} AS rolling_3_hour_average_trip_count, rank() OVER (PARTITION BY ingestion_id ORDER BY trip_count DESC) AS demand_rank,
  {_ratio("CAST(trip_count AS HUGEINT) * 100", "CAST(sum(trip_count) OVER (PARTITION BY ingestion_id) AS HUGEINT)", 4, "DECIMAL(8,4)")} AS period_trip_share_percentage
FROM (SELECT *, lag(trip_count) OVER (PARTITION BY ingestion_id ORDER BY pickup_hour) AS previous FROM hourly_totals)"""


def _key(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order} NULLS LAST) AS SMALLINT)"


def _names(column: str, names: list[str], part: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({part} AS INT)) AS {column}"


_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

CTES = {
    "raw": TRIPS_SQL.format(TS="TIMESTAMP", EVENTS="events"),
    "log": f"""
SELECT r.ingestion_id::BIGINT AS ingestion_id, source_file_name, 'yellow' AS taxi_type, 2024 AS period_year, 1 AS period_month, r.ingestion_id::BIGINT * 1000 AS file_size_bytes, status,
  CASE WHEN status = 'completed' THEN coalesce(n, 0) ELSE 0 END AS rows_read, CASE WHEN status = 'completed' THEN coalesce(n, 0) ELSE 0 END AS rows_loaded, 0::BIGINT AS rows_rejected,
  {_AT} AS started_at, CASE WHEN status <> 'started' THEN {_AT} END AS completed_at, error_message
FROM (VALUES {_RUNS}) AS r(ingestion_id, source_file_name, status, error_message) LEFT JOIN (SELECT ingestion_id, count(*) AS n FROM raw GROUP BY 1) USING (ingestion_id)""",
    "joined": "SELECT t.*, source_file_name, taxi_type, period_year, period_month, status AS ingestion_status FROM raw t JOIN log USING (ingestion_id)",
    "staging": f"""
SELECT raw_trip_id, ingestion_id, source_file_name, taxi_type, period_year, period_month, ingestion_status, vendor_id, pickup_datetime, dropoff_datetime, passenger_count, trip_distance,
  ratecode_id, store_and_fwd_flag, pickup_location_id, dropoff_location_id, payment_type,
  {_case("vendor_id", VENDORS)} AS vendor_name, {_case("ratecode_id", RATECODES)} AS ratecode_name, {_case("payment_type", PAYMENTS)} AS payment_type_name, {_case("store_and_fwd_flag", STORE_AND_FWD)} AS store_and_fwd_description,
  {", ".join(f"CAST({c} AS DECIMAL(12,2)) AS {c}" for c in MONEY_COLUMNS)}, loaded_at, CAST(pickup_datetime AS DATE) AS pickup_date, CAST(hour(pickup_datetime) AS INT) AS pickup_hour,
  {_SECONDS} / 60.0::DOUBLE AS trip_duration_minutes, CASE WHEN dropoff_datetime > pickup_datetime AND trip_distance > 0 THEN trip_distance / ({_SECONDS} / 3600.0::DOUBLE) END AS average_speed_mph,
  {", ".join(f"({_FLAG_SQL[f]}) AS {f}" for f in FLAGS)}
FROM joined""",
    "eligible": "SELECT * FROM staging WHERE ingestion_status = 'completed' AND pickup_date IS NOT NULL AND NOT is_pickup_outside_expected_period",
    "daily": f"SELECT {KEYS}, pickup_date, {_MEASURES} FROM eligible GROUP BY {KEYS}, pickup_date",
    "hourly": f"SELECT {KEYS}, pickup_date, pickup_hour, {_MEASURES} FROM eligible GROUP BY {KEYS}, pickup_date, pickup_hour",
    "daily_mart": _daily_summary("daily"),
    "hourly_totals": _HOURLY_TOTALS,
    "hourly_mart": _PROFILE,
    "dim_ingestion": "SELECT ingestion_id, source_file_name, taxi_type, period_year, period_month, file_size_bytes, status AS ingestion_status, rows_read, rows_loaded, rows_rejected, started_at, completed_at, error_message FROM log",
    "dim_date": f"""
SELECT CAST(strftime(full_date, '%Y%m%d') AS INT) AS date_key, full_date, CAST(year(full_date) AS INT) AS calendar_year, CAST(quarter(full_date) AS INT) AS calendar_quarter, CAST(month(full_date) AS INT) AS month_number,
  {_names("month_name", _MONTHS, "month(full_date)")}, CAST(day(full_date) AS INT) AS day_of_month, CAST(isodow(full_date) AS INT) AS day_of_week, {_names("day_name", _DAYS, "isodow(full_date)")},
  CAST(week(full_date) AS INT) AS iso_week, isodow(full_date) >= 6 AS is_weekend
FROM (SELECT CAST(unnest(generate_series(least(min(pickup_datetime::DATE), min(dropoff_datetime::DATE)), greatest(max(pickup_datetime::DATE), max(dropoff_datetime::DATE)), INTERVAL 1 DAY)) AS DATE) AS full_date FROM staging)""",
    "dim_hour": "SELECT CAST(h AS SMALLINT) AS hour_key, lpad(h::VARCHAR, 2, '0') || ':00' AS hour_label, CASE WHEN h < 6 THEN 'Night' WHEN h < 12 THEN 'Morning' WHEN h < 18 THEN 'Afternoon' ELSE 'Evening' END AS day_period FROM range(24) AS r(h)",
    "dim_vendor": f"SELECT {_key('vendor_id')} AS vendor_key, * FROM (SELECT DISTINCT vendor_id, vendor_name, is_unrecognized_vendor FROM staging WHERE vendor_id IS NOT NULL)",
    "dim_rate_code": f"SELECT {_key('ratecode_id')} AS rate_code_key, * FROM (SELECT DISTINCT ratecode_id, coalesce(ratecode_name, '{MISSING}') AS ratecode_name, is_unrecognized_ratecode, is_documented_unknown_ratecode, ratecode_id IS NULL AS is_missing FROM staging)",
    "dim_payment_type": f"SELECT {_key('payment_type')} AS payment_type_key, * FROM (SELECT DISTINCT payment_type, payment_type_name, is_unrecognized_payment_type, is_documented_unknown_payment_type FROM staging WHERE payment_type IS NOT NULL)",
    "dim_store_and_fwd": f"SELECT {_key('store_and_fwd_flag')} AS store_and_fwd_key, * FROM (SELECT DISTINCT store_and_fwd_flag, coalesce(store_and_fwd_description, '{MISSING}') AS store_and_fwd_description, is_unrecognized_store_and_fwd, store_and_fwd_flag IS NULL AS is_missing FROM staging)",
    "fact": f"""
SELECT raw_trip_id, s.ingestion_id, p.date_key AS pickup_date_key, d.date_key AS dropoff_date_key, CAST(hour(pickup_datetime) AS SMALLINT) AS pickup_hour_key, CAST(hour(dropoff_datetime) AS SMALLINT) AS dropoff_hour_key,
  vendor_key, rate_code_key, payment_type_key, store_and_fwd_key, pickup_datetime, dropoff_datetime, pickup_location_id, dropoff_location_id, passenger_count, trip_distance, trip_duration_minutes, average_speed_mph,
  {", ".join(MONEY_COLUMNS)}, loaded_at, {", ".join(f"s.{f} AS {f}" for f in FLAGS)}
FROM staging s JOIN dim_date p ON p.full_date = CAST(pickup_datetime AS DATE) JOIN dim_date d ON d.full_date = CAST(dropoff_datetime AS DATE) JOIN dim_vendor v ON v.vendor_id = s.vendor_id
  JOIN dim_rate_code r ON r.ratecode_id IS NOT DISTINCT FROM s.ratecode_id JOIN dim_payment_type y ON y.payment_type = s.payment_type JOIN dim_store_and_fwd f ON f.store_and_fwd_flag IS NOT DISTINCT FROM s.store_and_fwd_flag""",
    "fact_eligible": "SELECT f.*, source_file_name, taxi_type, period_year, period_month, CAST(pickup_datetime AS DATE) AS pickup_date, CAST(pickup_hour_key AS INT) AS pickup_hour FROM fact f JOIN log USING (ingestion_id) WHERE status = 'completed' AND NOT is_pickup_outside_expected_period",
    "fact_daily": f"SELECT {KEYS}, pickup_date, {_MEASURES} FROM fact_eligible GROUP BY {KEYS}, pickup_date",
    "fact_hourly": f"SELECT {KEYS}, pickup_date, pickup_hour, {_MEASURES} FROM fact_eligible GROUP BY {KEYS}, pickup_date, pickup_hour",
    "fact_daily_mart": _daily_summary("fact_daily"),
    "fact_hourly_totals": _HOURLY_TOTALS.replace("FROM hourly ", "FROM fact_hourly "),
    "fact_hourly_mart": _PROFILE.replace("FROM hourly_totals", "FROM fact_hourly_totals"),
    "main": "SELECT * FROM raw WHERE ingestion_id = 7",
    "main_staging": "SELECT * FROM staging WHERE ingestion_id = 7",
}
PRELUDE = "WITH " + ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in CTES.items()) + "\n"

_DAY = "DATE '2024-01-01'"
_END = "DATE '2024-02-01'"
_OVER = "dropoff_datetime - pickup_datetime > INTERVAL '24' HOUR"


def _if(condition: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


def _percent(condition: str, name: str) -> str:
    return _ratio(f"CAST(count(*) FILTER ({condition}) AS HUGEINT) * 100", "count(*)", 4, "DECIMAL(8,4)") + f" AS {name}"


def _ranges(source: str, rows: str = "daily_row_count", days: str = "distinct_pickup_dates", key: str = "pickup_date") -> str:
    return f"SELECT ingestion_id, count(*) AS {rows}, count(DISTINCT {key}) AS {days}, CAST(sum(trip_count) AS BIGINT) AS represented_trip_count, min({key}) AS first_{key}, max({key}) AS last_{key} FROM {source} GROUP BY ingestion_id"


def _hour_ranges(source: str) -> str:
    return f"""SELECT ingestion_id, count(*) AS hourly_row_count, count(DISTINCT (pickup_date, pickup_hour)) AS distinct_date_hours, count(DISTINCT pickup_date) AS represented_days, count(DISTINCT pickup_hour) AS represented_hours,
CAST(sum(trip_count) AS BIGINT) AS represented_trip_count, min(pickup_date) AS first_pickup_date, max(pickup_date) AS last_pickup_date, min(pickup_hour) AS first_pickup_hour, max(pickup_hour) AS last_pickup_hour FROM {source} GROUP BY ingestion_id"""


_ADDITIVE = validation.ADDITIVE


def _kind(c: str) -> str:
    return "DECIMAL(18,2)" if c.endswith("amount") else "BIGINT"


def _totals(source: str) -> str:
    return f"SELECT ingestion_id, {', '.join(f'CAST(sum({c}) AS {_kind(c)}) AS {c}' for c in _ADDITIVE)} FROM {source} GROUP BY ingestion_id"


_STAGING_TOTALS = f"""SELECT ingestion_id, count(*) AS trip_count, {", ".join(f"count(*) FILTER ({f}) AS {c}" for c, f in COUNTS.items())},
CAST(coalesce(sum(total_amount) FILTER (total_amount > 0), 0) AS DECIMAL(18,2)) AS positive_total_amount, CAST(coalesce(sum(total_amount) FILTER (total_amount < 0), 0) AS DECIMAL(18,2)) AS negative_total_amount,
CAST(coalesce(sum(total_amount), 0) AS DECIMAL(18,2)) AS net_total_amount FROM eligible GROUP BY ingestion_id"""


def _reconcile(expected: str, actual: str) -> str:
    columns = ", ".join(f"a.{c} - e.{c} AS {c}_difference" for c in _ADDITIVE)
    return f"SELECT coalesce(e.ingestion_id, a.ingestion_id) AS ingestion_id, {columns}, CASE WHEN a.ingestion_id IS NULL THEN 'actual' WHEN e.ingestion_id IS NULL THEN 'expected' END AS missing_side FROM ({expected}) e FULL JOIN ({actual}) a ON e.ingestion_id = a.ingestion_id"


def _differ(columns: list[str], a: str = "e", b: str = "a") -> str:
    return " OR ".join(f"{a}.{c} IS DISTINCT FROM {b}.{c}" for c in columns)


def _diff(expected: str, actual: str, keys: list[str], columns: list[str]) -> str:
    on = " AND ".join(f"e.{k} = a.{k}" for k in keys)
    key = ", ".join(f"coalesce(e.{k}, a.{k}) AS {k}" for k in keys)
    return f"SELECT {key}, CASE WHEN a.{keys[0]} IS NULL THEN 'actual' WHEN e.{keys[0]} IS NULL THEN 'expected' END AS missing_side FROM ({expected}) e FULL JOIN ({actual}) a ON {on} WHERE {_differ(columns)} OR e.{keys[0]} IS NULL OR a.{keys[0]} IS NULL"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


_ROLLED = [c for c in ("trip_count", *COUNTS, "positive_total_amount", "negative_total_amount", "net_total_amount")]
_SPEED = f"(SELECT *, {_SECONDS} / 60.0::DOUBLE AS trip_duration_minutes FROM main)"
_FAST = f"(SELECT *, CASE WHEN trip_duration_minutes > 0 THEN trip_distance / (trip_duration_minutes / 60) END AS average_speed_mph FROM {_SPEED})"
_QUALITY = {
    "complete_duplicates": f"(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM main GROUP BY {', '.join(RAW_COLUMNS)}))",
    **{k: f"(SELECT count(*) FILTER ({c}) FROM {_FAST})" for k, c in {
        "non_positive_duration": "trip_duration_minutes <= 0", "negative_distance": "trip_distance < 0", "zero_distance": "trip_distance = 0", "negative_fare": "fare_amount < 0",
        "negative_total_amount": "total_amount < 0", "pickup_outside_period": f"pickup_datetime < {_DAY} OR pickup_datetime >= {_END}", "speed_over_limit": "average_speed_mph > 80",
    }.items()},
}
_FK = {"ingestion_id": ("log", "ingestion_id"), "pickup_date_key": ("dim_date", "date_key"), "dropoff_date_key": ("dim_date", "date_key"), "pickup_hour_key": ("dim_hour", "hour_key"), "dropoff_hour_key": ("dim_hour", "hour_key"), "vendor_key": ("dim_vendor", "vendor_key"), "rate_code_key": ("dim_rate_code", "rate_code_key"), "payment_type_key": ("dim_payment_type", "payment_type_key"), "store_and_fwd_key": ("dim_store_and_fwd", "store_and_fwd_key")}
_PRESERVED = [*validation.OPERATIONAL, *MONEY_COLUMNS, *FLAGS]
_MART = ", ".join(analytics.DAILY_COLUMNS)
_DIMS = ["dim_ingestion", "dim_date", "dim_hour", "dim_vendor", "dim_rate_code", "dim_payment_type", "dim_store_and_fwd"]


def _shown(name: str, table: str | None = None) -> str:
    return f"SELECT * FROM {table or name}"


_CHECK_RULES = {
    "log": {"log_year_in_range": "period_year BETWEEN 2000 AND 2100", "log_month_in_range": "period_month BETWEEN 1 AND 12", "log_size_not_negative": "file_size_bytes >= 0", "log_status_known": "status IN ('started', 'completed', 'failed', 'skipped')", "log_counts_not_negative": "rows_read >= 0 AND rows_loaded >= 0 AND rows_rejected >= 0"},
    "raw": {"raw_trip_id_present": "raw_trip_id IS NOT NULL", "raw_ingestion_id_present": "ingestion_id IS NOT NULL"},
    "fact": {"fact_pickup_location_positive": "pickup_location_id > 0", "fact_dropoff_location_positive": "dropoff_location_id > 0", "fact_timestamps_present": "pickup_datetime IS NOT NULL AND dropoff_datetime IS NOT NULL", "fact_vendor_present": "vendor_key IS NOT NULL"},
    "dim_date": {"date_month_in_range": "month_number BETWEEN 1 AND 12", "date_day_in_range": "day_of_month BETWEEN 1 AND 31", "date_weekday_in_range": "day_of_week BETWEEN 1 AND 7", "date_week_in_range": "iso_week BETWEEN 1 AND 53"},
    "dim_hour": {"hour_in_range": "hour_key BETWEEN 0 AND 23", "hour_period_known": "day_period IN ('Night', 'Morning', 'Afternoon', 'Evening')"},
    "dim_rate_code": {"rate_code_missing_means_null": "is_missing = (ratecode_id IS NULL)"},
    "dim_store_and_fwd": {"flag_missing_means_null": "is_missing = (store_and_fwd_flag IS NULL)"},
}
_UNIQUE = {"dim_vendor": "vendor_id", "dim_rate_code": "ratecode_id", "dim_payment_type": "payment_type", "dim_store_and_fwd": "store_and_fwd_flag", "dim_ingestion": "ingestion_id", "dim_date": "full_date"}

def _upserted(key: str, code: str, dim: str) -> str:
    columns = f"(SELECT * EXCLUDE ({key}), {code} IN (SELECT {code} FROM staging WHERE ingestion_id = 1) OR ({code} IS NULL AND EXISTS (SELECT 1 FROM staging WHERE ingestion_id = 1 AND {code} IS NULL)) AS old FROM {dim})"
    return f"SELECT CAST(row_number() OVER (ORDER BY coalesce(old, false) DESC, {code} NULLS LAST) AS SMALLINT) AS {key}, * EXCLUDE (old) FROM {columns}"


def _prepared(c: str) -> str:
    rule = {"passenger_count": 13, "trip_distance": 17}
    return f"CASE WHEN (raw_trip_id - 1) % {rule[c]} = 0 THEN NULL ELSE {c} END AS {c}" if c in rule else c


_STATISTICS = "SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM main WHERE fare_amount < 0 OR total_amount < 0"

SELECTS = {
    "prepare_raw": f"SELECT {', '.join(map(_prepared, RAW_COLUMNS))} FROM raw",
    "dim_hour": _shown("dim_hour"),
    "dim_vendor_upserted": _upserted("vendor_key", "vendor_id", "dim_vendor"),
    "dim_rate_code_upserted": _upserted("rate_code_key", "ratecode_id", "dim_rate_code"),
    "dim_payment_type_upserted": _upserted("payment_type_key", "payment_type", "dim_payment_type"),
    "fact_trip_upserted": _shown("fact"),
    "r15_duplicate_rows": "SELECT " + _QUALITY["complete_duplicates"] + " AS duplicate_rows",
    "r16_amount_statistics": _union(_STATISTICS.format(c=c) for c in ("fare_amount", "tip_amount", "total_amount")),
    "staging_taxi_trips": _shown("staging"),
    "daily_trip_metrics": _shown("daily"),
    "hourly_trip_metrics": _shown("hourly"),
    "daily_mobility_summary": _shown("daily_mart"),
    "hourly_demand_profile": _shown("hourly_mart"),
    "daily_mobility_summary_fact": _shown("fact_daily_mart"),
    "hourly_demand_profile_fact": _shown("fact_hourly_mart"),
    **{d: _shown(d) for d in ("dim_ingestion", "dim_date", "dim_vendor", "dim_rate_code", "dim_payment_type", "dim_store_and_fwd")},
    "fact_trip": _shown("fact"),
    "model_summary": "SELECT ingestion_id, source_file_name, status AS ingestion_status, count(*) AS trip_count, min(pickup_datetime) AS minimum_pickup_datetime, max(pickup_datetime) AS maximum_pickup_datetime, CAST(sum(total_amount) AS DECIMAL(22,2)) AS total_amount FROM fact JOIN log USING (ingestion_id) GROUP BY ALL",
    "r01_preview": "SELECT raw_trip_id, ingestion_id, pickup_datetime, dropoff_datetime, passenger_count, trip_distance, total_amount FROM main ORDER BY raw_trip_id LIMIT 10",
    "r02_row_counts": "SELECT ingestion_id, count(*) AS trip_count FROM raw GROUP BY 1",
    "r02_total_rows": "SELECT count(*) AS total_rows FROM raw",
    "r03_null_counts": _union(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, {_percent(f'{c} IS NULL', 'null_percentage')} FROM main" for c in RAW_COLUMNS),
    "r04_null_patterns": "SELECT count(*) FILTER (passenger_count IS NULL AND ratecode_id IS NULL) AS both_columns_null, count(*) FILTER (passenger_count IS NULL AND ratecode_id IS NOT NULL) AS only_passenger_count_null, count(*) FILTER (passenger_count IS NOT NULL AND ratecode_id IS NULL) AS only_ratecode_id_null FROM main",
    "r04_missing_passengers": "SELECT raw_trip_id, vendor_id, pickup_datetime, passenger_count, ratecode_id, payment_type FROM main WHERE passenger_count IS NULL ORDER BY raw_trip_id LIMIT 10",
    **{f"r05_{n}_distribution": f"SELECT {c}, count(*) AS trip_count FROM main GROUP BY 1" for n, c in (("payment", "payment_type"), ("vendor", "vendor_id"), ("ratecode", "ratecode_id"))},
    "r06_category_nulls": "SELECT count(*) FILTER (payment_type = 0 AND passenger_count IS NULL AND ratecode_id IS NULL) AS payment_type_zero_and_both_null, count(*) FILTER (payment_type = 0 AND (passenger_count IS NOT NULL OR ratecode_id IS NOT NULL)) AS payment_type_zero_with_any_value, count(*) FILTER (payment_type <> 0 AND (passenger_count IS NULL OR ratecode_id IS NULL)) AS nonzero_payment_type_with_any_null FROM main",
    "r07_numeric_summary": "SELECT " + ", ".join(f"min({c}) AS minimum_{c}, max({c}) AS maximum_{c}, CAST(sum(CAST({c} AS DECIMAL(20,8))) AS DECIMAL(18,2)) AS sum_{c}, {_mean_exact(c, 'true')} AS average_{c}" for c in ("trip_distance", "fare_amount", "total_amount")) + " FROM main",
    "r08_threshold_counts": "SELECT " + ", ".join(", ".join([_if(f"{c} = 0", f"{c}_zero"), _if(f"{c} < 0", f"{c}_negative"), _if(f"{c} > 100", f"{c}_over_100"), _if(f"{c} > 1000", f"{c}_over_1000")]) for c in ("trip_distance", "fare_amount", "total_amount")) + " FROM main",
    "r09_sign_combinations": "SELECT count(*) AS total_rows, count(*) - count(fare_amount) AS fare_amount_null_rows, count(*) - count(total_amount) AS total_amount_null_rows, count(*) FILTER (fare_amount < 0 AND total_amount < 0) AS both_amounts_negative, count(*) FILTER (fare_amount < 0 AND total_amount >= 0) AS negative_fare_nonnegative_total, count(*) FILTER (fare_amount >= 0 AND total_amount < 0) AS nonnegative_fare_negative_total FROM main",
    "r10_datetime_profile": f"SELECT min(pickup_datetime) AS minimum_pickup_datetime, max(pickup_datetime) AS maximum_pickup_datetime, min(dropoff_datetime) AS minimum_dropoff_datetime, max(dropoff_datetime) AS maximum_dropoff_datetime, {_if(f'pickup_datetime < {_DAY}', 'pickup_before_period')}, {_if(f'pickup_datetime >= {_DAY} AND pickup_datetime < {_END}', 'pickup_during_period')}, {_if(f'pickup_datetime >= {_END}', 'pickup_after_period')}, count(*) - count(pickup_datetime) AS pickup_datetime_null_rows, count(*) - count(dropoff_datetime) AS dropoff_datetime_null_rows, {_if('dropoff_datetime <= pickup_datetime', 'nonpositive_duration_rows')}, {_if(_OVER, 'duration_over_24_hours_rows')} FROM main",
    "r10_shortest_durations": "SELECT raw_trip_id, pickup_datetime, dropoff_datetime, trip_distance, total_amount, CAST(date_diff('second', pickup_datetime, dropoff_datetime) AS BIGINT) AS trip_duration_seconds FROM main WHERE dropoff_datetime <= pickup_datetime ORDER BY dropoff_datetime - pickup_datetime, raw_trip_id LIMIT 10",
    "r11_distinct_flags": "SELECT DISTINCT store_and_fwd_flag FROM main",
    "r11_vendor_by_payment": "SELECT vendor_id, payment_type, count(*) AS trip_count FROM main GROUP BY 1, 2",
    "r12_flag_labels": "SELECT CASE WHEN store_and_fwd_flag IS NULL THEN '[NULL]' WHEN store_and_fwd_flag = '' THEN '[EMPTY STRING]' ELSE store_and_fwd_flag END AS store_and_fwd_value, count(*) AS trip_count FROM main GROUP BY 1",
    "r12_rare_vendors": "SELECT vendor_id, count(*) AS trip_count FROM main GROUP BY 1 HAVING count(*) < 2000",
    "r12_rare_payments": "SELECT payment_type, count(*) AS trip_count FROM main GROUP BY 1 HAVING count(*) < 100",
    "r13_trips_with_run": "SELECT raw_trip_id, pickup_datetime, trip_distance, total_amount, ingestion_id, source_file_name, taxi_type, period_year, period_month, status FROM main JOIN log USING (ingestion_id) ORDER BY raw_trip_id LIMIT 10",
    "r13_loaded_and_stored": "SELECT l.ingestion_id, source_file_name, status, rows_loaded, count(raw_trip_id) AS database_trip_count FROM log l LEFT JOIN raw t ON t.ingestion_id = l.ingestion_id GROUP BY ALL",
    "r13_orphan_rows": "SELECT count(*) AS orphan_trip_rows FROM raw WHERE ingestion_id NOT IN (SELECT ingestion_id FROM log)",
    "r14_profile_summary": f"SELECT count(*) AS total_rows, {_if('payment_type = 0', 'payment_type_zero_rows')}, {_percent('payment_type = 0', 'payment_type_zero_percentage')}, {_if('trip_distance = 0', 'zero_distance_rows')}, {_percent('trip_distance = 0', 'zero_distance_percentage')}, {_if('fare_amount < 0', 'negative_fare_rows')}, {_if('total_amount < 0', 'negative_total_rows')}, {_if('dropoff_datetime <= pickup_datetime', 'nonpositive_duration_rows')}, {_if(_OVER, 'duration_over_24_hours_rows')}, {_if(f'pickup_datetime < {_DAY} OR pickup_datetime >= {_END}', 'pickup_outside_period_rows')} FROM main",
    "r15_quality_summary": "SELECT indicator, record_count, " + _ratio("CAST(record_count AS HUGEINT) * 100", "n", 4, "DECIMAL(8,4)") + " AS percentage FROM (" + _union(f"SELECT '{k}' AS indicator, {c} AS record_count" for k, c in _QUALITY.items()) + "), (SELECT count(*) AS n FROM main)",
    "r16_negative_transactions": "SELECT raw_trip_id, vendor_id, pickup_datetime, payment_type, fare_amount, tip_amount, total_amount FROM main WHERE fare_amount < 0 OR total_amount < 0",
    "r17_zero_distances": f"SELECT raw_trip_id, pickup_datetime, dropoff_datetime, trip_distance, trip_duration_minutes, total_amount FROM {_SPEED} WHERE trip_distance = 0",
    "r17_speeding": f"SELECT raw_trip_id, trip_distance, trip_duration_minutes, average_speed_mph FROM {_FAST} WHERE average_speed_mph > 80 ORDER BY average_speed_mph DESC, raw_trip_id LIMIT 20",
    "r17_nonpositive_durations": f"SELECT raw_trip_id, pickup_datetime, dropoff_datetime, trip_duration_minutes, trip_distance, total_amount FROM {_SPEED} WHERE trip_duration_minutes <= 0",
    "v01_raw_and_staging": "SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM staging) AS staging_rows",
    "v02_distinct_trips": "SELECT ingestion_id, count(*) AS total_rows, count(DISTINCT raw_trip_id) AS distinct_trip_ids FROM staging GROUP BY 1",
    "v03_flag_counts": f"SELECT count(*) AS total_rows, {', '.join(f'count(*) FILTER ({f}) AS {f}_rows' for f in FLAGS)}, count(average_speed_mph) AS calculated_speed_rows FROM main_staging",
    "v04_inconsistent_speeds": "SELECT count(*) AS inconsistent_speed_rows FROM main_staging WHERE is_valid_for_speed_analysis <> (average_speed_mph IS NOT NULL)",
    "v05_money_precision": "SELECT " + ", ".join(f"max(abs({c})) AS max_abs_{c}, count(*) FILTER (CAST({c} AS DECIMAL(30,9)) <> round(CAST({c} AS DECIMAL(30,9)), 2)) AS {c}_over_2_decimals" for c in MONEY_COLUMNS) + " FROM main",
    "v06_code_counts": _union(f"SELECT '{c}' AS field_name, coalesce({c}::VARCHAR, 'NULL') AS field_value, count(*) AS row_count FROM main_staging GROUP BY 2" for c in validation.CODES),
    "v06_unrecognized_codes": f"SELECT count(*) FILTER (vendor_id NOT IN {_list(VENDORS)}) AS unrecognized_vendor_rows, count(*) FILTER (ratecode_id NOT IN {_list(RATECODES)}) AS unrecognized_ratecode_rows, count(*) FILTER (payment_type NOT IN {_list(PAYMENTS)}) AS unrecognized_payment_type_rows, count(*) FILTER (store_and_fwd_flag NOT IN {_list(STORE_AND_FWD)}) AS unrecognized_store_and_fwd_rows FROM main_staging",
    "v07_daily_ranges": _ranges("daily"),
    "v08_grain": _union(f"SELECT '{k}' AS layer, count(*) AS violations FROM (SELECT 1 FROM {t} GROUP BY {g} HAVING count(*) > 1)" for k, t, g in (("daily", "daily", "ingestion_id, pickup_date"), ("hourly", "hourly", "ingestion_id, pickup_date, pickup_hour"), ("daily_mart", "fact_daily_mart", "ingestion_id, pickup_date"), ("hourly_mart", "fact_hourly_mart", "ingestion_id, pickup_hour"), ("fact", "fact", "raw_trip_id"))),
    "v09_daily_reconciliation": _reconcile(_STAGING_TOTALS, _totals("daily")),
    "v10_monetary_identity": "SELECT ingestion_id, pickup_date, positive_total_amount, negative_total_amount, net_total_amount FROM daily WHERE positive_total_amount + negative_total_amount <> net_total_amount",
    "v11_outside_month": f"SELECT ingestion_id, period_year, period_month, pickup_date FROM daily WHERE pickup_date < {_START} OR pickup_date >= {_START} + INTERVAL '1' MONTH",
    "v12_known_daily": _ranges("(SELECT * FROM daily WHERE ingestion_id = 7)"),
    "v13_hourly_ranges": _hour_ranges("hourly"),
    "v14_hourly_reconciliation": _reconcile(_STAGING_TOTALS, _totals("hourly")),
    "v15_hourly_against_daily": _diff("SELECT * FROM daily", f"SELECT ingestion_id, pickup_date, {', '.join(f'CAST(sum({c}) AS {_kind(c)}) AS {c}' for c in _ROLLED)} FROM hourly GROUP BY 1, 2", ["ingestion_id", "pickup_date"], _ROLLED),
    "v16_invalid_hours": f"SELECT ingestion_id, period_year, period_month, pickup_date, pickup_hour FROM hourly WHERE pickup_hour NOT BETWEEN 0 AND 23 OR pickup_date < {_START} OR pickup_date >= {_START} + INTERVAL '1' MONTH",
    "v17_known_hourly": _hour_ranges("(SELECT * FROM hourly WHERE ingestion_id = 7)"),
    "v18_daily_mart_ranges": _ranges("fact_daily_mart", "mart_row_count", "distinct_pickup_dates"),
    "v19_daily_mart_totals": _reconcile(_totals("daily"), _totals("fact_daily_mart")),
    "v20_daily_mart_windows": _diff(_daily_summary(f"(SELECT {_MART} FROM fact_daily_mart)"), "SELECT * FROM fact_daily_mart", ["ingestion_id", "pickup_date"], validation.DAILY_WINDOWS),
    "v21_daily_mart_final": "SELECT f.ingestion_id, f.pickup_date AS final_pickup_date, f.cumulative_trip_count, f.cumulative_net_total_amount, expected_final_trip_count, expected_final_net_total_amount, rounded_period_trip_share_percentage FROM (SELECT *, row_number() OVER (PARTITION BY ingestion_id ORDER BY pickup_date DESC) AS k FROM fact_daily_mart) f JOIN (SELECT ingestion_id, CAST(sum(trip_count) AS BIGINT) AS expected_final_trip_count, CAST(sum(net_total_amount) AS DECIMAL(18,2)) AS expected_final_net_total_amount, CAST(sum(period_trip_share_percentage) AS DECIMAL(12,4)) AS rounded_period_trip_share_percentage FROM fact_daily_mart GROUP BY 1) p ON p.ingestion_id = f.ingestion_id WHERE k = 1",
    "v22_known_daily_mart": "SELECT ingestion_id, count(*) AS represented_days, CAST(sum(trip_count) AS BIGINT) AS represented_trips, max(cumulative_trip_count) FILTER (pickup_date = DATE '2024-01-30') AS final_cumulative_trip_count, max(cumulative_net_total_amount) FILTER (pickup_date = DATE '2024-01-30') AS final_cumulative_net_total_amount, min(trip_demand_rank) AS best_demand_rank, max(trip_demand_rank) AS lowest_demand_rank FROM fact_daily_mart WHERE ingestion_id = 7 GROUP BY 1",
    "v23_hourly_mart_ranges": _ranges("fact_hourly_mart", "mart_row_count", "distinct_pickup_hours", "pickup_hour"),
    "v24_hourly_mart_totals": _diff("SELECT * FROM hourly_totals", "SELECT * FROM fact_hourly_mart", ["ingestion_id", "pickup_hour"], ["represented_day_count", *_ADDITIVE]),
    "v25_hourly_mart_windows": _diff("SELECT * FROM hourly_mart", "SELECT * FROM fact_hourly_mart", ["ingestion_id", "pickup_hour"], ["average_daily_trip_count", *[c.replace("_trip_count", "_percentage") for c in list(COUNTS)[:4]], "trip_count", "represented_day_count", *COUNTS, "positive_total_amount", "negative_total_amount", "net_total_amount", "average_net_total_amount_per_trip", "previous_hour_trip_count", "hourly_trip_count_change", "hourly_trip_count_change_percentage", "cumulative_trip_count", "rolling_3_hour_average_trip_count", "demand_rank", "period_trip_share_percentage"]),
    "v26_invalid_percentages": "SELECT ingestion_id, pickup_hour FROM fact_hourly_mart WHERE positive_total_amount + negative_total_amount <> net_total_amount OR " + " OR ".join(f"{c} NOT BETWEEN 0 AND 100" for c in [*[c.replace("_trip_count", "_percentage") for c in list(COUNTS)[:4]], "period_trip_share_percentage"]),
    "v27_hourly_mart_final": "SELECT ingestion_id, count(*) AS represented_hours, CAST(sum(trip_count) AS BIGINT) AS represented_trips, max(cumulative_trip_count) FILTER (pickup_hour = 23) AS final_cumulative_trip_count, CAST(sum(net_total_amount) AS DECIMAL(18,2)) AS expected_net_total_amount, CAST(sum(period_trip_share_percentage) AS DECIMAL(12,4)) AS rounded_period_trip_share_percentage, min(demand_rank) AS best_demand_rank, max(demand_rank) AS lowest_demand_rank, max(pickup_hour) FILTER (demand_rank = 1) AS highest_demand_hour, max(trip_count) FILTER (demand_rank = 1) AS highest_demand_trip_count FROM fact_hourly_mart GROUP BY 1",
    "v28_object_counts": _union(f"SELECT '{n}' AS object_name, count(*) AS row_count FROM {t}" for n, t in [*[(d, d) for d in _DIMS], ("fact_trip", "fact")]),
    "v29_fact_grain": "SELECT count(*) AS total_rows, count(DISTINCT raw_trip_id) AS distinct_trip_ids, count(*) - count(DISTINCT raw_trip_id) AS duplicate_rows FROM fact",
    "v30_fact_coverage": "SELECT coalesce(s.ingestion_id, f.ingestion_id) AS ingestion_id, coalesce(f.n, 0) - coalesce(s.n, 0) AS trip_count_difference FROM (SELECT ingestion_id, count(*) AS n FROM staging GROUP BY 1) s FULL JOIN (SELECT ingestion_id, count(*) AS n FROM fact GROUP BY 1) f ON s.ingestion_id = f.ingestion_id",
    "v31_fact_ids": "SELECT count(*) FILTER (f.raw_trip_id IS NULL) AS missing_from_fact, count(*) FILTER (s.raw_trip_id IS NULL) AS additional_in_fact FROM staging s FULL JOIN fact f ON s.raw_trip_id = f.raw_trip_id",
    "v32_foreign_key_orphans": "SELECT " + ", ".join(f"(SELECT count(*) FROM fact WHERE {k} NOT IN (SELECT {p} FROM {d})) AS {k}_orphans" for k, (d, p) in _FK.items()),
    "v33_audit_against_dim": _diff("SELECT * RENAME (status AS ingestion_status) FROM log", "SELECT * FROM dim_ingestion", ["ingestion_id"], ["source_file_name", "taxi_type", "period_year", "period_month", "file_size_bytes", "ingestion_status", "rows_read", "rows_loaded", "rows_rejected", "started_at", "completed_at", "error_message"]),
    "v34_date_ranges": "SELECT min(full_date) AS minimum_date, max(full_date) AS maximum_date, count(*) AS date_count, count(DISTINCT date_key) AS distinct_date_key_count, count(DISTINCT full_date) AS distinct_full_date_count FROM dim_date",
    "v34_wrong_dates": "SELECT date_key, full_date FROM dim_date WHERE date_key <> year(full_date) * 10000 + month(full_date) * 100 + day(full_date) OR iso_week <> weekofyear(full_date) OR day_of_week <> isodow(full_date)",
    "v34_missing_dates": "SELECT full_date FROM (SELECT CAST(pickup_datetime AS DATE) AS full_date FROM staging UNION SELECT CAST(dropoff_datetime AS DATE) FROM staging) d WHERE NOT EXISTS (SELECT 1 FROM dim_date x WHERE x.full_date = d.full_date)",
    "v35_hour_ranges": "SELECT CAST(min(hour_key) AS INT) AS minimum_hour, CAST(max(hour_key) AS INT) AS maximum_hour, count(*) AS hour_count, count(DISTINCT hour_key) AS distinct_hour_count, (SELECT count(*) FROM range(24) AS r(h) WHERE h NOT IN (SELECT hour_key FROM dim_hour)) AS missing_hours, (SELECT count(DISTINCT hour(pickup_datetime)) FROM raw) AS hours_of_trips FROM dim_hour",
    "v36_categorical_differences": _union(f"SELECT '{d}' AS dimension_name, count(*) AS difference_count FROM ((({w}) EXCEPT ({h})) UNION ALL (({h}) EXCEPT ({w})))" for d, w, h in (
        ("dim_vendor", "SELECT vendor_id, vendor_name, is_unrecognized_vendor FROM staging", "SELECT vendor_id, vendor_name, is_unrecognized_vendor FROM dim_vendor"),
        ("dim_rate_code", f"SELECT ratecode_id, coalesce(ratecode_name, '{MISSING}'), is_unrecognized_ratecode, is_documented_unknown_ratecode, ratecode_id IS NULL FROM staging", "SELECT * EXCLUDE (rate_code_key) FROM dim_rate_code"),
        ("dim_payment_type", "SELECT payment_type, payment_type_name, is_unrecognized_payment_type, is_documented_unknown_payment_type FROM staging", "SELECT * EXCLUDE (payment_type_key) FROM dim_payment_type"),
        ("dim_store_and_fwd", f"SELECT store_and_fwd_flag, coalesce(store_and_fwd_description, '{MISSING}'), is_unrecognized_store_and_fwd, store_and_fwd_flag IS NULL FROM staging", "SELECT * EXCLUDE (store_and_fwd_key) FROM dim_store_and_fwd"),
    )),
    "v37_key_derivation": "SELECT count(*) FILTER (f.pickup_date_key IS DISTINCT FROM CAST(strftime(s.pickup_datetime, '%Y%m%d') AS INT)) AS pickup_date_key_mismatches, count(*) FILTER (f.dropoff_date_key IS DISTINCT FROM CAST(strftime(s.dropoff_datetime, '%Y%m%d') AS INT)) AS dropoff_date_key_mismatches, count(*) FILTER (f.pickup_hour_key IS DISTINCT FROM hour(s.pickup_datetime)) AS pickup_hour_key_mismatches, count(*) FILTER (f.dropoff_hour_key IS DISTINCT FROM hour(s.dropoff_datetime)) AS dropoff_hour_key_mismatches, count(*) FILTER (v.vendor_id IS DISTINCT FROM s.vendor_id) AS vendor_key_mismatches, count(*) FILTER (r.ratecode_id IS DISTINCT FROM s.ratecode_id) AS rate_code_key_mismatches, count(*) FILTER (p.payment_type IS DISTINCT FROM s.payment_type) AS payment_type_key_mismatches, count(*) FILTER (w.store_and_fwd_flag IS DISTINCT FROM s.store_and_fwd_flag) AS store_and_fwd_key_mismatches FROM staging s JOIN fact f USING (raw_trip_id) JOIN dim_vendor v USING (vendor_key) JOIN dim_rate_code r USING (rate_code_key) JOIN dim_payment_type p USING (payment_type_key) JOIN dim_store_and_fwd w USING (store_and_fwd_key)",
    "v38_preserved_columns": _union(f"SELECT '{c}' AS column_name, count(*) FILTER (s.{c} IS DISTINCT FROM f.{c}) AS mismatch_count FROM staging s JOIN fact f USING (raw_trip_id)" for c in _PRESERVED),
    "v41_monetary_differences": "SELECT s.ingestion_id, " + ", ".join(f"CAST(f.{c} - s.{c} AS DECIMAL(18,2)) AS {c}_difference" for c in MONEY_COLUMNS) + " FROM " + " JOIN ".join(f"(SELECT ingestion_id, {', '.join(f'sum({c}) AS {c}' for c in MONEY_COLUMNS)} FROM {t} GROUP BY 1) {a}" for t, a in (("staging", "s"), ("fact", "f"))) + " ON s.ingestion_id = f.ingestion_id",
    "v43_constraints": _union([*(f"SELECT '{k}' AS check_name, count(*) FILTER (NOT ({c})) AS violations FROM {t}" for t, rules in _CHECK_RULES.items() for k, c in rules.items()), *(f"SELECT '{d}_unique' AS check_name, count(*) AS violations FROM (SELECT 1 FROM {d} GROUP BY {k} HAVING count(*) > 1)" for d, k in _UNIQUE.items())]),
}
#: Footers are no view: the SQL names the file that the tables are checked on.
EVENTS_FILE = "/root/testdata/sf0.01/events.parquet"
_RAW_TYPES = {"raw_trip_id": "n", "ingestion_id": "n", **{c: "t" if c in TIMESTAMP_COLUMNS else "f" if c in DOUBLE_COLUMNS else "n" for c in RAW_COLUMNS}, "loaded_at": "t"}
_PLAIN = {"n": "{c}::VARCHAR", "t": "epoch_us({c})::VARCHAR", "f": "CAST(round({c} * 10000) AS BIGINT)::VARCHAR"}
_DIGEST = "md5('42' || " + " || ".join("'|' || coalesce(" + _PLAIN[kind].format(c=c) + ", '')" for c, kind in _RAW_TYPES.items()) + ")"
_PERIOD = "'yellow' AS taxi_type, 2024 AS period_year, 1 AS period_month"
_COUNT = "(SELECT count(*) FROM raw WHERE ingestion_id = {})".format
_MONTH_ROWS, _SAMPLE_ROWS = _COUNT(7), _COUNT(1)
_CHECKED = ["ingestion status is completed", "source file name matches", "source file size matches", "Parquet rows match rows_read", "rows_read match rows_loaded", "rows_loaded match stored count", "rows_rejected is zero"]
SELECTS |= {
    "s08_sample_trips": f"SELECT * FROM raw ORDER BY {_DIGEST}, raw_trip_id LIMIT 5000",
    "s03_manifest_rows": "SELECT (SELECT count(*) FROM events) AS footer_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM events)) AS columns, (SELECT count(*) FROM events) AS scanned_rows",
    "s03_parquet_manifest": f"SELECT file_name AS path, num_rows AS rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM events)) AS columns, num_row_groups AS row_groups, file_size_bytes FROM parquet_file_metadata('{EVENTS_FILE}')",
    "s03_row_groups": f"""
SELECT g.*, g.rows AS rows_read, (SELECT max(event_id) FROM events) AS last_event_id
FROM (SELECT DISTINCT file_name AS path, CAST(row_group_id AS INT) AS row_group, row_group_num_rows AS rows, row_group_bytes AS bytes, CAST(row_group_num_columns AS INT) AS columns FROM parquet_metadata('{EVENTS_FILE}')) g""",
    "v42_failed_checks": f"SELECT unnest([{', '.join(map(repr, _CHECKED))}]) AS check_name, unnest([{', '.join(repr('FAIL' if 'stored' in c else 'PASS') for c in _CHECKED)}]) AS result",
    "d05_failed_reconciliation": f"""
SELECT CAST(5 AS BIGINT) AS ingestion_id, 'failed' AS status, n AS rows_read, CAST(0 AS BIGINT) AS rows_loaded,
  'Row counts differ: footer ' || {_MONTH_ROWS} || ', read ' || n || ', loaded ' || n AS error_message, {_MONTH_ROWS} + {_SAMPLE_ROWS} AS raw_rows, CAST(2 AS BIGINT) AS ingestions
FROM (SELECT count(*) AS n FROM raw WHERE ingestion_id = 7 AND dropoff_datetime IS NOT NULL)""",
    "d11_audit_states": f"""
SELECT CAST(i AS BIGINT) AS ingestion_id, f AS source_file_name, {_PERIOD}, s AS status, CAST(n AS BIGINT) AS rows_read, CAST(n AS BIGINT) AS rows_loaded, CAST(0 AS BIGINT) AS rows_rejected, TRUE AS has_ended, s = 'failed' AS has_error
FROM (SELECT 1 AS i, 'month.parquet' AS f, 'completed' AS s, {_MONTH_ROWS} AS n UNION ALL SELECT 2, 'month.parquet', 'skipped', 0
  UNION ALL SELECT 3, 'sample.parquet', 'completed', {_SAMPLE_ROWS} UNION ALL SELECT 4, 'broken.parquet', 'failed', 0)""",
    "s06_raw_by_ingestion": f"""
SELECT CAST(CASE ingestion_id WHEN 7 THEN 1 ELSE 3 END AS BIGINT) AS ingestion_id, count(*) AS row_count, CASE ingestion_id WHEN 7 THEN 1 ELSE {_MONTH_ROWS} + 1 END AS first_trip_id,
  CASE ingestion_id WHEN 7 THEN {_MONTH_ROWS} ELSE {_MONTH_ROWS} + {_SAMPLE_ROWS} END AS last_trip_id, count(*) AS distinct_trip_ids, CAST(sum(CAST(total_amount AS DECIMAL(20,8))) AS DECIMAL(28,8)) AS total_amount, count(*) AS rows_loaded_now
FROM raw WHERE ingestion_id IN (1, 7) GROUP BY raw.ingestion_id""",
    "d06_deleted_rows": f"SELECT 'deleted' AS step, {_MONTH_ROWS} AS row_count UNION ALL SELECT 'deleted again', 0 UNION ALL SELECT 'left', {_SAMPLE_ROWS}",
    "v42_ingestion_checks": f"SELECT unnest([{', '.join(map(repr, _CHECKED))}]) AS check_name, {_MONTH_ROWS} = (SELECT count(*) FROM raw WHERE ingestion_id = 7) AS passed",
    "s02_pruned_scan": "SELECT vendor_id, count(*) AS row_count, CAST(sum(CAST(fare_amount AS DECIMAL(20,8))) AS DECIMAL(28,8)) AS fare_amount FROM raw WHERE ingestion_id = 7 GROUP BY vendor_id",
    "s09_saved_fact": "SELECT count(*) AS trip_count, count(DISTINCT raw_trip_id) AS distinct_trip_ids, sum(total_amount) AS total_amount FROM fact WHERE ingestion_id = 7",
    "o01_null_order": "SELECT passenger_count, row_count, CAST(row_number() OVER (ORDER BY passenger_count ASC NULLS LAST) AS INT) AS rising, CAST(row_number() OVER (ORDER BY passenger_count DESC NULLS FIRST) AS INT) AS falling FROM (SELECT passenger_count, count(*) AS row_count FROM raw GROUP BY 1)",
    "dim_hour": "SELECT h.*, (SELECT count(*) FROM staging WHERE hour(pickup_datetime) = h.hour_key) AS pickup_count, (SELECT count(*) FROM staging WHERE hour(dropoff_datetime) = h.hour_key) AS dropoff_count FROM dim_hour h",
}
ORACLES = {name: PRELUDE + select for name, select in SELECTS.items()}
