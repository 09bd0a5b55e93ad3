"""Idempotent ingestion of one file, with its audit trail and a reconciliation of row counts.

Loads may run at the same time, from any number of applications. Of loads of one file
the one of the smallest id goes first, the others wait for it and skip. A load
that dies holds nobody up for longer than its lease: the next load ends it as
completed, if its rows are in the table, or else as failed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import prepare_raw
from . import audit, files
from .parquet import check_file, parquet_manifest, read_trips
from .raw import AlreadyLoaded, assign_trip_ids, delete_ingestion, fence, publish_raw, stage_raw
from .tables import ROW_GROUP_BYTES


@dataclass(frozen=True)
class Result:
    ingestion_id: int
    status: str
    rows_read: int
    rows_loaded: int


def reconcile(footer: int, read: int, loaded: int) -> None:
    if not footer == read == loaded:
        raise ValueError(f"Row counts differ: footer {footer}, read {read}, loaded {loaded}")


def recover(spark: SparkSession, root: str, lease: float = audit.LEASE) -> list[int]:
    """End all dead runs: completed where their rows are in the table, failed where not; their ids."""
    log_path, raw_path = f"{root}/audit", f"{root}/raw"
    dead = [r["ingestion_id"] for r in audit.open_runs(spark, log_path) if not audit.is_alive(spark, log_path, r["ingestion_id"], lease)]
    for ingestion_id in dead:
        rows = fence(spark, raw_path, ingestion_id)
        with suppress(audit.Ended):  # by another one that recovers, or by itself
            if rows is None:
                audit.fail_ingestion(spark, log_path, ingestion_id, f"The run gave no sign of life for {lease:g} seconds")
            else:
                audit.complete_ingestion(spark, log_path, ingestion_id, rows, rows)
        for name in files.names(spark, root):
            if name.startswith(f"staged-{ingestion_id}-"):
                files.remove(spark, f"{root}/{name}")
    return dead


def _wait_for_earlier(spark: SparkSession, root: str, ingestion_id: int, run: dict, lease: float) -> None:
    """Until no run of the same file with a smaller id is under way."""
    while any(r["ingestion_id"] < ingestion_id and all(r[k] == v for k, v in run.items()) for r in audit.open_runs(spark, f"{root}/audit")):
        time.sleep(min(1.0, lease / 10))
        recover(spark, root, lease)


def ingest(spark: SparkSession, path: str, taxi_type: str, period_year: int, period_month: int, root: str, prepare: Callable[[DataFrame], DataFrame] = prepare_raw, lease: float = audit.LEASE) -> Result:
    """Load a file into ``root``/raw once; ``root``/audit tells what happened.

    A file that a completed ingestion loaded already is skipped. Trip ids follow
    those of the ingestion before; a failed one leaves a gap. On any error
    nothing of it gets into the table, the run is marked failed, and the error is
    raised again.
    """
    log_path, raw_path = f"{root}/audit", f"{root}/raw"
    check_file(spark, path)
    footer = parquet_manifest(spark, path).agg(F.sum("rows").alias("rows"), F.sum("file_size_bytes").alias("size")).first()
    run = dict(source_file_name=path.rstrip("/").rsplit("/", 1)[-1], taxi_type=taxi_type, period_year=period_year, period_month=period_month, file_size_bytes=footer["size"])
    recover(spark, root, lease)
    loaded = lambda: audit.find_completed(audit.audit_log(spark, log_path), **run) is not None
    if loaded():
        return Result(audit.record_skipped(spark, log_path, **run), "skipped", 0, 0)
    ingestion_id = audit.start_ingestion(spark, log_path, rows=footer["rows"], **run)
    staged, read = f"{root}/staged-{ingestion_id}-{uuid.uuid4().hex}", 0
    with audit.heartbeat(spark, log_path, ingestion_id, lease):
        try:
            _wait_for_earlier(spark, root, ingestion_id, run, lease)
            if loaded():
                raise AlreadyLoaded
            prepare(read_trips(spark, path)).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(staged)  # a file of one large row group is dealt to many tasks from here
            prepared = spark.read.parquet(staged)
            read = prepared.count()
            written = stage_raw(assign_trip_ids(prepared, audit.trip_ids(spark, log_path, ingestion_id)[0]), ingestion_id, raw_path)
            reconcile(footer["rows"], read, written.rows)
            publish_raw(spark, raw_path, written, ingestion_id, list(run.values()))
            audit.complete_ingestion(spark, log_path, ingestion_id, read, written.rows)
        except AlreadyLoaded:
            fence(spark, raw_path, ingestion_id)
            audit.skip_ingestion(spark, log_path, ingestion_id)
            return Result(ingestion_id, "skipped", 0, 0)
        except Exception as error:
            if fence(spark, raw_path, ingestion_id) is not None:
                delete_ingestion(spark, raw_path, ingestion_id)
            with suppress(audit.Ended):
                audit.fail_ingestion(spark, log_path, ingestion_id, str(error), rows_read=read)
            raise
        finally:
            files.remove(spark, staged)
    audit.compact(spark, log_path)
    return Result(ingestion_id, "completed", read, written.rows)
