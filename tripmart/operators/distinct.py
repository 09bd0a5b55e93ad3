"""Exact counts of distinct ids, and of repeated rows, that shuffle little."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_ids(t: DataFrame, keys: list[str], key: str, name: str = "distinct_ids", rows: str = "total_rows") -> DataFrame:
    """Rows, and distinct integer ids without null, by ``keys``.

    For ids that are dense, as row numbers are: each 32,768 of them are a bitmap of 4
    KB, built before the shuffle, so that a partition of neighbouring ids sends an
    eighth of a byte a row. Sparse ids would send a bitmap each.
    """
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key)))
    parts = t.groupBy(*keys, F.bitmap_bucket_number(F.col(key)).alias("__bucket")).agg(F.count(F.lit(1)).alias("__rows"), bits.alias("__bits"))
    return parts.groupBy(*keys).agg(F.coalesce(F.sum("__rows"), F.lit(0)).alias(rows), F.coalesce(F.sum(F.bitmap_count("__bits")), F.lit(0)).alias(name))


def row_digest(columns: dict[str, str]) -> list[Column]:
    """Two 64-bit hashes of a row of columns (name and type); nulls, -0.0 and NaN count as groups count them."""

    def plain(c: str, kind: str) -> Column:
        return F.col(f"`{c}`") + F.lit(0.0).cast(kind) if kind in ("double", "float") else F.col(f"`{c}`")  # -0.0 becomes 0.0

    names = list(columns)
    masks = [reduce(lambda a, b: a + b, [F.when(F.col(f"`{c}`").isNull(), 1 << k).otherwise(0).cast("long") for k, c in enumerate(names[a : a + 60])], F.lit(0).cast("long")) for a in range(0, len(names), 60)]
    values = [plain(c, kind) for c, kind in columns.items()]
    return [F.xxhash64(F.lit(1), *masks, *values), F.xxhash64(F.lit(2), *reversed(values), *masks)]


def repeated_rows(t: DataFrame, columns: list[str]) -> DataFrame:
    """One row with how many rows repeat an earlier one in all columns, nulls being equal: duplicate_rows.

    Digests of 16 bytes are shuffled; only the rows of digests that occur again are compared themselves.
    """
    kinds = dict(t.dtypes)
    own = t.select(*[F.col(f"`{c}`") for c in columns])
    a, b = row_digest({c: kinds[c] for c in columns})
    tagged = own.withColumns({"__a": a, "__b": b})
    again = tagged.select("__a", "__b").groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__a", "__b")
    suspects = tagged.join(again, ["__a", "__b"], "left_semi").groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    return suspects.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
