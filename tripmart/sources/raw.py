"""The raw trip table, partitioned by ingestion, in versions.

A load writes its rows beside the table and publishes them as a partition, or
not at all; loads at the same time don't meet. The partition also tells which file it
came from, so a file is never in two of them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, tables


def assign_trip_ids(t: DataFrame, base: int = 0) -> DataFrame:
    """raw_trip_id = base + 1, base + 2, ... without gaps and without a global sort.

    ``t`` has to give the same rows in the same partitions each time (a written
    table does): rows are numbered inside partitions, and partitions by how many
    rows stand before them. Offsets are a row a partition.
    """
    numbered = t.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = {r["__part"]: r["n"] for r in numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, offsets = base + 1, []
    for part in sorted(sizes):
        offsets.append((part, offset))
        offset += sizes[part]
    before = t.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    ids = numbered.join(F.broadcast(before), "__part", "left")
    return ids.select((F.col("__offset") + F.col("__row")).alias("raw_trip_id"), *t.columns)


class AlreadyLoaded(RuntimeError):
    """Another ingestion has published the same file."""


class Fenced(RuntimeError):
    """The ingestion was taken for dead and may publish nothing any more."""


def stage_raw(t: DataFrame, ingestion_id: int, path: str) -> tables.Written:
    """Write prepared trips beside the table. Ids have to rise inside partitions, as ``assign_trip_ids`` gives them: nothing is sorted."""
    tagged = t.withColumns({"ingestion_id": F.lit(ingestion_id).cast("long"), "loaded_at": F.current_timestamp().cast("timestamp_ntz")})
    return tables.write_partition(tagged, path, ["ingestion_id"], _part(ingestion_id), ["raw_trip_id"], name=f"{ingestion_id}-")


def publish_raw(spark: SparkSession, path: str, written: tables.Written, ingestion_id: int, identity: list | None = None) -> None:
    """Make staged rows an ingestion of the table, unless its file is there or the ingestion was fenced off."""

    def check(now: tables.Version | None) -> None:
        if now and ingestion_id in now.notes.get("fenced", []):
            raise Fenced(f"ingestion {ingestion_id} was taken for dead")
        if now and identity is not None and any(p.get("file") == identity for p in now.parts.values()):
            raise AlreadyLoaded(f"{identity} is loaded")

    tables.add(spark, path, written, {"file": identity, "rows": written.rows}, check)


def append_raw(t: DataFrame, ingestion_id: int, path: str) -> int:
    """Append prepared trips, in any order, as one ingestion; the number of rows written."""
    written = stage_raw(t.sortWithinPartitions("raw_trip_id"), ingestion_id, path)
    publish_raw(t.sparkSession, path, written, ingestion_id)
    return written.rows


def fence(spark: SparkSession, path: str, ingestion_id: int) -> int | None:
    """The rows that an ingestion has published; if it hasn't, it never will, and what it has staged goes."""
    found: list[int] = []

    def change(now: tables.Version | None) -> tables.Version:
        now = now or tables.Version(0, "", [], {})
        if (part := now.parts.get(_part(ingestion_id))) is not None:
            found.append(part["rows"])
            raise AlreadyLoaded
        return replace(now, notes=now.notes | {"fenced": [*now.notes.get("fenced", []), ingestion_id]})

    try:
        tables.commit(spark, path, change)
    except AlreadyLoaded:
        return found[0]
    for name in files.names(spark, path):
        if name.startswith(f"__version={ingestion_id}-"):
            files.remove(spark, f"{path}/{name}")
    return None


def _part(ingestion_id: int) -> str:
    return f"ingestion_id={ingestion_id}"


def raw_trips(spark: SparkSession, path: str, ingestion_id: int | None = None) -> DataFrame:
    """The raw table; with an id only that partition is read."""
    t = tables.read_table(spark, path)
    return t if ingestion_id is None else t.where(F.col("ingestion_id") == ingestion_id)


def delete_ingestion(spark: SparkSession, path: str, ingestion_id: int) -> int:
    """Take one ingestion's rows out of the table; how many there were."""
    now = tables.current(spark, path)
    part = now.parts.get(_part(ingestion_id)) if now else None
    if part is None:
        return 0
    tables.drop(spark, path, [_part(ingestion_id)])
    tables.vacuum(spark, path)
    return part["rows"]
