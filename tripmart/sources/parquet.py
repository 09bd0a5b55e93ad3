"""Reading trip files, their footers and samples, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


_path = files.locate


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def check_file(spark: SparkSession, path: str) -> str:
    """``path`` of a Parquet file; errors for a missing path, a folder, or another suffix."""
    fs, where = _path(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(f"Parquet file does not exist: {path}")
    if not fs.getFileStatus(where).isFile():
        raise ValueError(f"Path is not a file: {path}")
    if not path.lower().endswith(".parquet"):
        raise ValueError(f"File is not a Parquet file: {path}")
    return path


def read_trips(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A trip file; with ``columns`` only these are read from the store."""
    t = spark.read.parquet(path)
    return t.select(*columns) if columns else t


def parquet_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, rows, columns, row_groups and file_size_bytes of each file, from footers read on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("file_size_bytes"))

    def footers(batches):
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            rows, columns, groups = [], [], []
            for uri in batch.column("path").to_pylist():
                store, where = fs.FileSystem.from_uri(uri)
                with store.open_input_file(where) as source:
                    meta = pq.ParquetFile(source).metadata
                rows.append(meta.num_rows)
                columns.append(meta.num_columns)
                groups.append(meta.num_row_groups)
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("path"), long(rows), long(columns), long(groups), batch.column("file_size_bytes")], names=["path", "rows", "columns", "row_groups", "file_size_bytes"])

    return files.mapInArrow(footers, "path string, rows long, columns long, row_groups long, file_size_bytes long")


GROUP_SCHEMA = "path string, row_group int, rows long, bytes long, columns int"


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """path, row_group, rows, bytes (uncompressed) and columns of each row group, from footers read on the executors."""
    files_ = spark.read.format("binaryFile").load(path).select("path")

    def footers(batches):
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            out = []
            for uri in batch.column("path").to_pylist():
                store, where = fs.FileSystem.from_uri(uri)
                with store.open_input_file(where) as source:
                    meta = pq.ParquetFile(source).metadata
                groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
                out += [(uri, k, g.num_rows, g.total_byte_size, g.num_columns) for k, g in enumerate(groups)]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "row_group", "rows", "bytes", "columns"])

    return files_.mapInArrow(footers, GROUP_SCHEMA)


def read_row_groups(spark: SparkSession, path: str, indexes: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of some row groups of a file, or of all, with the number of their group as ``row_group``.

    Each group is one task's, which streams it. An index that the file doesn't have is an IndexError.
    """
    check_file(spark, path)
    found = row_groups(spark, path).orderBy("row_group").collect()  # a row a group
    wanted = range(len(found)) if indexes is None else indexes
    for k in wanted:
        if not 0 <= k < len(found):
            raise IndexError(f"Row group index is outside the valid range. Received {k}; valid range: 0 to {len(found) - 1}.")
    t = spark.read.parquet(path)
    schema = (t.select(*[f"`{c}`" for c in columns]) if columns else t).schema
    names = schema.fieldNames()
    if not len(wanted):
        return spark.createDataFrame([], f"row_group int, {_ddl(schema)}")
    places = spark.createDataFrame([(found[k]["path"], k) for k in wanted], "path string, row_group int").repartition(len(wanted), "row_group")

    def read(batches):
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            for uri, k in zip(batch.column("path").to_pylist(), batch.column("row_group").to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(uri)
                with store.open_input_file(where) as source:
                    for rows in pq.ParquetFile(source).iter_batches(row_groups=[k], columns=names):
                        yield pa.RecordBatch.from_arrays([pa.array([k] * rows.num_rows, pa.int32()), *[rows.column(c) for c in names]], names=["row_group", *names])

    return places.mapInArrow(read, f"row_group int, {_ddl(schema)}")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _plain(name: str, kind: str) -> Column:
    """A value as text that any engine writes alike: numbers in ten-thousandths, times in microseconds, null as nothing."""
    c = F.col(name)
    if kind in ("double", "float"):
        c = F.round(c * 10_000).cast("long")
    elif kind == "timestamp_ntz":
        c = F.unix_micros(F.to_timestamp_ltz(c))
    elif kind == "timestamp":
        c = F.unix_micros(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def sample_trips(t: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones for the same rows and seed: the smallest by a digest of all columns."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_plain(c, kind) for c, kind in t.dtypes]))
    return t.orderBy(digest, *t.columns).limit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which the session names; a local one on one machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the application."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _path(spark, path)
    fs.deleteOnExit(where)
    return path


def stored(t: DataFrame, name: str) -> DataFrame:
    """``t`` written once to the shared folder and read again: computed once, and of a size that Spark knows."""
    path = scratch(t.sparkSession, name)
    t.write.parquet(path)
    return t.sparkSession.read.schema(t.schema).parquet(path)


def _rename(fs, old, new) -> None:
    """Hadoop tells a failed rename by its result alone."""
    if not fs.rename(old, new):
        raise OSError(f"could not rename {old} to {new}")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Logical views: evaluated anew by each query."""
    for name, t in tables.items():
        t.createOrReplaceTempView(name)
