"""Session settings that the wide projections of this library need."""

from __future__ import annotations

from pyspark.sql import SparkSession

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def jit_sized(spark: SparkSession) -> None:
    """Have no generated method that the JIT won't compile, unless the session says otherwise.

    The JVM interprets methods of over 8,000 bytes for ever. Spark's own limit is eight times as much,
    and staging's projection lies between: it runs four times as fast in several smaller methods,
    which is what Spark makes of it below the limit. Results don't change.
    """
    if spark.conf.get(LIMIT, "65535") == "65535":
        spark.conf.set(LIMIT, "8000")
