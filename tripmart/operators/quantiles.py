"""Exact statistics of columns without bringing all values of one to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.parquet import stored


def column_statistics(t: DataFrame, columns: list[str], shares: dict[str, float]) -> DataFrame:
    """A row per column: n, mean, std, min, max, and an interpolated quantile for each name in ``shares``; null where there are no values.

    One pass over ``t`` counts the values of all columns. These are dealt to
    partitions by range of column and value and numbered inside them; what stands
    before a partition is a sum over a row a partition. The rest reads the
    counted values.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    counts = t.select(F.inline(pairs)).where("x IS NOT NULL").groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange("column_name", "x").withColumn("part", F.spark_partition_id()), "ranged-values")
    n, x = F.col("n"), F.col("x")
    sizes = ranged.groupBy("column_name", "part").agg(F.sum("n").alias("size"), F.sum(x * n).alias("sum"), F.min("x").alias("least"), F.max("x").alias("most"))
    column = Window.partitionBy("column_name")
    total = F.sum("size").over(column)
    offsets = sizes.select("column_name", "part", (F.sum("size").over(column.orderBy("part")) - F.col("size")).alias("before"), total.alias("total"), (F.sum("sum").over(column) / total).alias("mean"), F.min("least").over(column).alias("min"), F.max("most").over(column).alias("max"))
    last = F.sum("n").over(Window.partitionBy("part", "column_name").orderBy("x"))
    ranks = ranged.withColumn("last", last).join(offsets, ["column_name", "part"]).withColumn("last", F.col("last") + F.col("before"))
    at = lambda rank: F.max(F.when((F.col("last") - n <= rank) & (rank < F.col("last")), x))
    place = {name: (F.col("total") - 1) * F.lit(share) for name, share in shares.items()}
    square = (x - F.col("mean")) * (x - F.col("mean")) * n
    found = ranks.groupBy("column_name").agg(
        F.max("total").alias("n"), F.max("mean").alias("mean"), F.sqrt(F.sum(square) / F.nullif(F.max("total") - 1, F.lit(0))).alias("std"), F.max("min").alias("min"), F.max("max").alias("max"),
        *[at(F.floor(p)).alias(f"{k}_low") for k, p in place.items()], *[at(F.ceil(p)).alias(f"{k}_high") for k, p in place.items()], *[F.max(p - F.floor(p)).alias(f"{k}_part") for k, p in place.items()],
    )
    quantiles = [(F.col(f"{k}_low") + F.col(f"{k}_part") * (F.col(f"{k}_high") - F.col(f"{k}_low"))).alias(k) for k in shares]
    names = t.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(found, "column_name", "left").select("column_name", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", *quantiles, "max")
