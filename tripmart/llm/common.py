"""Reading tables, cutting lineage in the shared folder, and Arrow maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, which the session names in ``spark.checkpoint.dir``.

    Only where one machine runs the driver and all tasks is a temporary folder made instead.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Later stages and lost executors read the files; nothing is computed twice.
    The files go with the application, or earlier with ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        fs, where = _place(t.sparkSession, t.cut_path)
        fs.delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a task makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def widened(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` with further columns, written as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def _plain(names: list[str]) -> list[str]:
    """The names, but for those that Spark only reads in quotes, which are numbered."""
    mark = "odd_"
    while any(n.lower().startswith(mark) for n in names):
        mark += "_"
    return [n if re.fullmatch(r"\w+", n) else f"{mark}{k}" for k, n in enumerate(names)]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for a function of one record batch, whatever the columns are called."""
    names = df.columns
    plain = _plain(names)
    odd_in = plain != names
    made = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out_names = made.fieldNames()
    out_plain = _plain(out_names)
    odd_out = out_plain != out_names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if (out := fn(batch.rename_columns(names) if odd_in else batch)) is not None:
                yield out.rename_columns(out_plain) if odd_out else out

    if not odd_in and not odd_out:
        return df.mapInArrow(run, schema)
    fields = [StructField(n, f.dataType, f.nullable) for n, f in zip(out_plain, made.fields, strict=True)]
    return df.toDF(*plain).mapInArrow(run, StructType(fields)).toDF(*out_names)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def grouped(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over the rows of each value of ``keys``, which callers keep to a bounded number.

    Sorted partitions are read as a stream and only one group is held at a
    time; many small groups cost no more than their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        ready: list[pa.RecordBatch] = []

        def close() -> None:
            if held and (out := fn(pa.Table.from_batches(held))) is not None and out.num_rows:
                ready.append(out)
            held.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(k) for k in keys]
            change = None
            for c in cols:
                values = c.to_numpy(zero_copy_only=False)
                c = values[1:] != values[:-1]
                change = c if change is None else change | c
            edges = [0, *(change.nonzero()[0] + 1).tolist(), n]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(c[a].as_py() for c in cols)
                if key != now:
                    close()
                    now = key
                held.append(batch.slice(a, b - a))
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        close()
        yield from ready

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
