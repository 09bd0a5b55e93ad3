"""Row-level comparison of two large tables by digests of buckets.

Neighbouring ids share a bucket. A bucket's digest is the sum of its rows'
hashes, so the order of rows doesn't matter, and partitions of neighbouring ids
send one row a bucket. Only rows of buckets that differ are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.parquet import stored
from .distinct import row_digest

WIDTH = 64


def _bucket(key: str, width: int) -> Column:
    return F.floor(F.col(key) / F.lit(width)).alias("__bucket")


def _digests(t: DataFrame, key: str, columns: list[str], width: int) -> DataFrame:
    kinds = dict(t.dtypes)
    sums = []
    for k, h in enumerate(row_digest({c: kinds[c] for c in [key, *columns]})):
        sums += [F.sum(F.shiftright(h, 32)).alias(f"__high{k}"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"__low{k}")]  # halves, so that no sum overflows
    return t.where(F.col(key).isNotNull()).groupBy(_bucket(key, width)).agg(F.count(F.lit(1)).alias("__n"), *sums)


def differing(expected: DataFrame, actual: DataFrame, key: str, columns: list[str], width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in buckets of ``key`` that are not equal in ``columns``, or not on both sides.

    Types have to be the same. Rows without a key are left out. The list of buckets is written, so
    that Spark knows whether it can be sent to all tasks; where it is empty, neither table is read again.
    """
    kinds = lambda t: [(c, dict(t.dtypes)[c]) for c in [key, *columns]]
    if kinds(expected) != kinds(actual):
        raise ValueError("the tables differ in types")
    e, a = _digests(expected, key, columns, width).alias("e"), _digests(actual, key, columns, width).alias("a")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("__n", "__high0", "__low0", "__high1", "__low1")]
    apart = stored(e.join(a, F.col("e.__bucket") == F.col("a.__bucket"), "full").where(~(same[0] & same[1] & same[2] & same[3] & same[4])).select(F.coalesce("e.__bucket", "a.__bucket").alias("__bucket")), "buckets")
    if apart.isEmpty():
        return expected.select(key, *columns).limit(0), actual.select(key, *columns).limit(0)
    some = lambda t: t.select(key, *columns).withColumn("__bucket", _bucket(key, width)).join(apart, "__bucket", "left_semi").drop("__bucket")
    return some(expected), some(actual)


def mismatches(expected: DataFrame, actual: DataFrame, key: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """Rows of equal key that differ, by column: column_name, mismatch_count."""
    e, a = differing(expected, actual, key, columns, width)
    both = e.alias("e").join(a.alias("a"), key)
    counts = both.agg(*[F.count_if(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "mismatch_count")


def missing_keys(expected: DataFrame, actual: DataFrame, key: str, missing: str, additional: str, width: int = WIDTH) -> DataFrame:
    """One row: how many rows of ``expected`` have no row of that key in ``actual``, and the other way round; a null key has none."""
    e, a = differing(expected.select(key), actual.select(key), key, [], width)
    both = e.select(F.col(key).alias("__e")).join(a.select(F.col(key).alias("__a")), F.col("__e") == F.col("__a"), "full")
    nulls = [t.where(F.col(key).isNull()).agg(F.count(F.lit(1)).alias(n)) for t, n in ((expected, "__e_null"), (actual, "__a_null"))]
    counted = both.agg(F.count_if(F.col("__a").isNull()).alias("__m"), F.count_if(F.col("__e").isNull()).alias("__x")).crossJoin(nulls[0]).crossJoin(nulls[1])
    return counted.select((F.col("__m") + F.col("__e_null")).alias(missing), (F.col("__x") + F.col("__a_null")).alias(additional))
