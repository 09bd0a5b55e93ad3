"""Tables in versions: writers add a folder, and a numbered pointer file makes it the table.

A version is a small file that names, for each partition, the folder with its
rows. It is created whole and once, so readers see one version or the next, and of
two writers at a time the later one looks again at what the first has done. A
failed writer leaves a folder that no version names. Replaced folders stay for
``KEEP_SECONDS``, for readers that opened them before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files

KEEP_SECONDS = 3600.0
#: Rows of a sorted table lie in row groups of so many bytes, so that a point query reads one of them.
ROW_GROUP_BYTES = 8 << 20
_VERSIONS = "_versions"


class Conflict(RuntimeError):
    """Another writer has replaced what this one wanted to replace."""


@dataclass(frozen=True)
class Version:
    """``parts``: by partition (a folder's name, empty without partitions) the folder of its rows and notes on them."""

    number: int
    schema: str
    partition_by: list[str]
    parts: dict[str, dict]
    notes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Written:
    """A folder that no version names yet."""

    folder: str
    schema: str
    partition_by: list[str]
    parts: dict[str, dict]
    rows: int


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest version."""
    found = [n for n in files.names(spark, f"{path}/{_VERSIONS}") if n.endswith(".json")]
    return Version(**json.loads(files.read(spark, f"{path}/{_VERSIONS}/{found[-1]}"))) if found else None


def commit(spark: SparkSession, path: str, change: Callable[[Version | None], Version]) -> Version:
    """Publish ``change`` of the newest version, again if another writer was first."""
    while True:
        now = current(spark, path)
        new = replace(change(now), number=now.number + 1 if now else 1)
        if files.publish(spark, f"{path}/{_VERSIONS}/{new.number:012d}.json", json.dumps(vars(new))):
            return new


def read_table(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The rows of the newest version, or of a given one; partition columns come last and prune."""
    version = version or current(spark, path)
    if version is None or not version.schema:
        raise FileNotFoundError(f"no table in {path}")
    schema = StructType.fromJson(json.loads(version.schema))
    folders = [f"{path}/{p['folder']}" + (f"/{name}" if name else "") for name, p in version.parts.items()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*[F.col(f"`{c}`") for c in schema.fieldNames()])


def _found(spark: SparkSession, place: str, depth: int) -> list[str]:
    """Names of partition folders, ``depth`` levels each."""
    here = [n for n in files.names(spark, place) if "=" in n]
    return here if depth == 1 else [f"{n}/{below}" for n in here for below in _found(spark, f"{place}/{n}", depth - 1)]


def write(t: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, name: str = "", finished: bool = True) -> Written:
    """Write rows beside the table.

    ``sort_by`` orders the rows of each file by columns that queries look up, in
    smaller row groups and with Bloom filters for them. A folder that is not ``finished`` lacks its
    mark, so that ``vacuum`` leaves it alone.
    """
    spark, keys = t.sparkSession, partition_by or []
    folder = f"__version={name}{uuid.uuid4().hex}"
    seen = Observation()
    out = _keys_last(t, keys).observe(seen, F.count(F.lit(1)).alias("n"))
    _save(out, f"{path}/{folder}", keys, sort_by, **({} if finished else {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}))
    parts = _found(spark, f"{path}/{folder}", len(keys)) if keys else [""]
    return Written(folder, out.schema.json(), keys, {p: {"folder": folder} for p in parts}, seen.get["n"])


def _save(t: DataFrame, place: str, keys: list[str], sort_by: list[str] | None, mode: str = "error", **options: str) -> None:
    writer = _indexed((t.sortWithinPartitions(*keys, *sort_by) if sort_by else t).write.options(**options), sort_by)
    (writer.partitionBy(*keys) if keys else writer).mode(mode).parquet(place)


def write_partition(t: DataFrame, path: str, partition_by: list[str], partition: str, sort_by: list[str], name: str = "") -> Written:
    """Write rows of one partition, named by its folder, beside the table, as ``write`` does.

    Rows stream into their files: those of each task come in the order of ``sort_by``
    already, and none is sorted or dealt by partition, so a task holds no more of a large load than of a small one.
    """
    spark, folder, seen = t.sparkSession, f"__version={name}{uuid.uuid4().hex}", Observation()
    out = _keys_last(t, partition_by)
    _indexed(out.drop(*partition_by).observe(seen, F.count(F.lit(1)).alias("n")).write, sort_by).parquet(f"{path}/{folder}/{partition}")
    files.publish(spark, f"{path}/{folder}/_SUCCESS", "")  # ``vacuum`` looks for it
    rows = seen.get["n"]
    return Written(folder, out.schema.json(), partition_by, {partition: {"folder": folder}} if rows else {}, rows)


def _keys_last(t: DataFrame, keys: list[str]) -> DataFrame:
    return t.select(*[F.col(f"`{c}`") for c in t.columns if c not in keys], *keys)


def _indexed(writer: DataFrameWriter, sort_by: list[str] | None) -> DataFrameWriter:
    """Small row groups, and Bloom filters for the columns that rows are sorted by."""
    if sort_by:
        writer = writer.option("parquet.block.size", ROW_GROUP_BYTES)
        for c in sort_by:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


def discard(spark: SparkSession, path: str, written: Written) -> None:
    files.remove(spark, f"{path}/{written.folder}")


def save_table(t: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, keep_seconds: float = KEEP_SECONDS) -> Version:
    """Replace a table, or create it; the last of several writers wins."""
    spark = t.sparkSession
    w = write(t, path, partition_by, sort_by)
    new = commit(spark, path, lambda now: Version(0, w.schema, w.partition_by, w.parts, now.notes if now else {}))
    vacuum(spark, path, keep_seconds)
    return new


def add(spark: SparkSession, path: str, w: Written, notes: dict | None = None, check: Callable[[Version | None], None] | None = None) -> Version:
    """Make written rows partitions of a table. Partitions of the same values are a ``Conflict``.

    ``notes`` are kept with the partitions. ``check`` sees the version that the
    new one follows, and may raise.
    """

    def change(now: Version | None) -> Version:
        if check:
            check(now)
        now = now if now is None or now.schema else replace(now, schema=w.schema, partition_by=w.partition_by)
        if now and (now.partition_by, _kinds(now.schema)) != (w.partition_by, _kinds(w.schema)):
            raise ValueError(f"columns or partitions differ from those of {path}")
        if now and (same := set(now.parts) & set(w.parts)):
            raise Conflict(f"{path} has {sorted(same)} already")
        parts = {p: v | (notes or {}) for p, v in w.parts.items()}
        return Version(0, now.schema if now else w.schema, w.partition_by, (now.parts if now else {}) | parts, now.notes if now else {})

    return commit(spark, path, change)


def _kinds(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(schema))]


def drop(spark: SparkSession, path: str, partitions: list[str], notes: dict | None = None, check: Callable[[Version | None], None] | None = None) -> Version | None:
    """Leave partitions out of the next version, which gets ``notes`` as a whole; None, and nothing done, if there is no table."""
    if current(spark, path) is None:
        return None

    def change(now: Version) -> Version:
        if check:
            check(now)
        return replace(now, parts={p: v for p, v in now.parts.items() if p not in partitions}, notes=now.notes | (notes or {}))

    return commit(spark, path, change)


def upsert_table(source: DataFrame, path: str, keys: list[str], partition_by: list[str], sort_by: list[str] | None = None, keep_seconds: float = KEEP_SECONDS) -> Version:
    """Insert rows or update those of equal keys in the partitions that ``source`` touches, and no others.

    ``source`` has one row a key, and a key never moves to another partition.
    Partitions without a row in ``source`` are neither read nor written. If
    another writer replaces a touched partition meanwhile, it is a ``Conflict``.

    ``source`` is computed once, into the new folder, which tells the partitions. Keys alone then tell
    whether old rows stay; only if some do, whole old rows are joined and added.
    """
    from ..operators.upsert import upsert

    spark = source.sparkSession
    base = current(spark, path)
    base = base if base and base.schema else None
    if base is not None:  # types that hold the values of both
        kinds = upsert(read_table(spark, path, base), source, keys).schema
        source = source.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds.fields])
    w = write(source, path, partition_by, sort_by, finished=False)
    if base is not None and (old := {p: v for p, v in base.parts.items() if p in w.parts}):
        target, new = read_table(spark, path, replace(base, parts=old)), read_table(spark, path, Version(0, w.schema, w.partition_by, w.parts))
        same = reduce(and_, [F.col(f"t.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys])
        rest = lambda t: t.alias("t").join(new.select(*[F.col(f"`{k}`") for k in keys]).alias("s"), same, "left_anti")
        if rest(target.select(*[F.col(f"`{k}`") for k in keys])).count():
            _save(rest(target).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in new.schema.fields]), f"{path}/{w.folder}", w.partition_by, sort_by, mode="append")
    files.publish(spark, f"{path}/{w.folder}/_SUCCESS", "")

    def change(now: Version | None) -> Version:
        before, after = (v.parts if v else {} for v in (base, now))
        if lost := [p for p in w.parts if before.get(p) != after.get(p)]:
            raise Conflict(f"another writer replaced {lost} of {path}")
        return Version(0, w.schema, w.partition_by, after | w.parts, now.notes if now else {})

    try:
        new = commit(spark, path, change)
    except Conflict:
        discard(spark, path, w)
        raise
    vacuum(spark, path, keep_seconds)
    return new


def vacuum(spark: SparkSession, path: str, keep_seconds: float = KEEP_SECONDS) -> None:
    """Delete versions that were replaced ``keep_seconds`` ago, and folders that no version left names.

    A version counts as replaced when the next one was written. Folders that are being
    written, or are younger than that, stay.
    """
    place = f"{path}/{_VERSIONS}"
    found = files.names(spark, place)
    for name, following in zip(found[:-1], found[1:], strict=True):
        if (age := files.age(spark, f"{place}/{following}")) is not None and age >= keep_seconds:
            files.remove(spark, f"{place}/{name}")
    named = set()
    for name in files.names(spark, place):
        try:
            named |= {p["folder"] for p in json.loads(files.read(spark, f"{place}/{name}"))["parts"].values()}
        except FileNotFoundError:  # another writer cleans up as well
            continue
    for name in files.names(spark, path):
        folder = f"{path}/{name}"
        if name.startswith("__version=") and name not in named and (files.age(spark, folder) or 0) >= keep_seconds and files.age(spark, f"{folder}/_SUCCESS") is not None:
            files.remove(spark, folder)
