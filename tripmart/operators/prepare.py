"""From a source file's columns to typed raw columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import strip, to_double_or_null, to_int_or_null, to_ts_or_null
from ..schema import DOUBLE_COLUMNS, INTEGER_COLUMNS, RAW_COLUMNS, SOURCE_COLUMNS, TEXT_COLUMNS, TIMESTAMP_COLUMNS


def require_columns(t: DataFrame, columns=tuple(SOURCE_COLUMNS)) -> DataFrame:
    """``t``, or an error that lists the missing columns in order."""
    if missing := sorted(set(columns) - set(t.columns)):
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return t


def rename_source(t: DataFrame) -> DataFrame:
    return t.withColumnsRenamed(SOURCE_COLUMNS)


def cast_raw(t: DataFrame) -> DataFrame:
    """Typed columns; what can't be read as the type becomes NULL."""
    casts = {c: to_int_or_null for c in INTEGER_COLUMNS} | {c: to_ts_or_null for c in TIMESTAMP_COLUMNS}
    casts |= {c: to_double_or_null for c in DOUBLE_COLUMNS} | {c: strip for c in TEXT_COLUMNS}
    return t.withColumns({c: cast(F.col(c)) for c, cast in casts.items()})


def select_raw(t: DataFrame) -> DataFrame:
    return t.select(*RAW_COLUMNS)


def prepare_raw(t: DataFrame) -> DataFrame:
    """Check, rename, cast and order the columns of a source file."""
    return t.transform(require_columns).transform(rename_source).transform(cast_raw).transform(select_raw)
