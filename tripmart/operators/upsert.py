"""Insert-or-update on a business key. Surrogate keys that exist are kept and nothing is deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame | None, source: DataFrame, keys: list[str], surrogate: str | None = None) -> DataFrame:
    """All rows of ``target``, with those of ``source`` in place of rows of equal key; nulls are equal keys.

    ``source`` has one row a key. With ``surrogate``, new rows get numbers that
    follow the largest; such tables are dimensions of a few rows, and only they
    are numbered by a window over all rows.
    """
    if surrogate is None:
        if target is None:
            return source
        same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
        kept = target.alias("t").join(source.select(*keys).alias("s"), same, "left_anti")
        return kept.select(*source.columns).unionByName(source)
    columns = source.columns
    if target is None:
        return source.withColumn(surrogate, F.row_number().over(Window.orderBy(*[F.asc_nulls_last(k) for k in keys])).cast("short")).select(surrogate, *columns)
    t, s = target.alias("t"), source.withColumn("__new", F.lit(True)).alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    both = t.withColumn("__old", F.lit(True)).alias("t").join(s, same, "full")
    merged = both.select(F.col(f"t.{surrogate}").alias(surrogate), *[F.when(F.col("s.__new"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns])
    top = F.coalesce(F.max(surrogate).over(Window.partitionBy(F.lit(1))), F.lit(0))
    rank = F.row_number().over(Window.orderBy(F.col(surrogate).isNotNull(), *[F.asc_nulls_last(k) for k in keys]))
    return merged.select(F.coalesce(surrogate, top + rank).cast("short").alias(surrogate), *columns)
