"""Generic checks: grain, differences of rows and totals, sets, orphans and expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_grain(t: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and their number of rows."""
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def _full(expected: DataFrame, actual: DataFrame, keys: list[str]) -> tuple[DataFrame, list[Column], Column]:
    e, a = expected.withColumn("__e", F.lit(1)).alias("e"), actual.withColumn("__a", F.lit(1)).alias("a")
    on = reduce(lambda x, y: x & y, [F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    key = [F.coalesce(f"e.{k}", f"a.{k}").alias(k) for k in keys]
    side = F.when(F.col("__a").isNull(), "actual").when(F.col("__e").isNull(), "expected").alias("missing_side")
    return e.join(a, on, "full"), key, side


def reconcile_totals(expected: DataFrame, actual: DataFrame, keys: list[str], measures: list[str], fill: bool = False) -> DataFrame:
    """actual - expected for each measure by key; NULL where a side lacks the key, or against 0 with ``fill``."""
    both, key, side = _full(expected, actual, keys)
    value = lambda s, m: F.coalesce(F.col(f"{s}.{m}"), F.lit(0)) if fill else F.col(f"{s}.{m}")
    return both.select(*key, *[(value("a", m) - value("e", m)).alias(f"{m}_difference") for m in measures], side)


def diff_rows(expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows differ in any column, nulls being equal, or stand on one side only."""
    both, key, side = _full(expected, actual, keys)
    differ = reduce(lambda x, y: x | y, [~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")) for c in columns])
    return both.where(differ | F.col("__e").isNull() | F.col("__a").isNull()).select(*key, side)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` without a parent."""
    return child.join(parent.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def expectations(t: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row (check_name, violations) for each rule that rows must meet; NULL counts as met. One pass."""
    counts = t.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "check_name", "violations")


def expect_unique(t: DataFrame, keys: list[str]) -> DataFrame:
    """Violating keys; a null key counts like any other."""
    return check_grain(t, keys)
