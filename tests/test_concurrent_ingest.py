"""Loads at the same time, in threads and in processes, and loads that die."""

import subprocess
import sys
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import ROOT
from tests.test_prepare import ROW
from tripmart.sources import audit, files, ingest, raw

RUN = dict(taxi_type="yellow", period_year=2025, period_month=1)

CHILD = """
import os, sys
from pyspark.sql import SparkSession
from tripmart.sources import audit, ingest, raw
root, path, die = sys.argv[1:]
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
def stop(*args, **options):
    os._exit(9)
if die == "claimed":
    ingest.stage_raw = stop
elif die == "staged":
    ingest.publish_raw = stop
elif die == "published":
    audit.complete_ingestion = stop
result = ingest.ingest(spark, path, "yellow", 2025, 1, root)
print("RESULT", result.status, result.rows_loaded)
"""


def month(folder, name: str, n: int) -> str:
    pq.write_table(pa.table({k: [v] * n for k, v in ROW.items()}), folder / name)
    return str(folder / name)


def child(root: str, path: str, die: str = "no") -> subprocess.Popen:
    return subprocess.Popen([sys.executable, "-c", CHILD, root, path, die], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, cwd=ROOT)


def outcome(p: subprocess.Popen) -> str:
    out, _ = p.communicate(timeout=240)
    return next((line.removeprefix("RESULT ") for line in out.splitlines() if line.startswith("RESULT")), f"exit {p.returncode}")


def log(spark, root: str) -> dict:
    return {r.ingestion_id: (r.status, r.rows_loaded) for r in audit.audit_log(spark, f"{root}/audit").collect()}


def stored(spark, root: str) -> list:
    return sorted(r.raw_trip_id for r in raw.raw_trips(spark, f"{root}/raw").collect())


def test_threads(spark, tmp_path):
    """Eight loads of four files: each is loaded once, and no two rows share an id."""
    root, paths = str(tmp_path / "lake"), [month(tmp_path, f"m{k}.parquet", 5 + k) for k in range(4)]
    with ThreadPoolExecutor(8) as pool:
        results = list(pool.map(lambda p: ingest.ingest(spark, p, root=root, lease=30.0, **RUN), paths * 2))
    assert sorted(r.status for r in results) == ["completed"] * 4 + ["skipped"] * 4
    assert sorted(r.rows_loaded for r in results) == [0, 0, 0, 0, 5, 6, 7, 8]
    ids = stored(spark, root)
    assert len(ids) == len(set(ids)) == 26
    assert sorted(log(spark, root).values()) == sorted((r.status, r.rows_loaded) for r in results)
    assert not [n for n in files.names(spark, root) if n.startswith("staged")]


def test_processes(spark, tmp_path):
    root, paths = str(tmp_path / "lake"), [month(tmp_path, f"m{k}.parquet", 5 + k) for k in range(2)]
    running = [child(root, p) for p in (paths[0], paths[1], paths[0])]
    got = sorted(map(outcome, running))
    assert got == ["completed 5", "completed 6", "skipped 0"]
    ids = stored(spark, root)
    assert len(ids) == len(set(ids)) == 11 and sorted(log(spark, root).values()) == [("completed", 5), ("completed", 6), ("skipped", 0)]


@pytest.mark.parametrize("die", ["claimed", "staged", "published"])
def test_a_load_that_dies_is_recovered(spark, tmp_path, die):
    root, path = str(tmp_path / "lake"), month(tmp_path, "m.parquet", 4)
    assert outcome(child(root, path, die)) == "exit 9"
    assert log(spark, root) == {1: ("started", 0)} and audit.is_alive(spark, f"{root}/audit", 1)
    began = time.monotonic()
    other = ingest.ingest(spark, month(tmp_path, "other.parquet", 3), root=root, **RUN)  # another file waits for nobody
    assert other.status == "completed" and time.monotonic() - began < 60
    result = ingest.ingest(spark, path, root=root, lease=1.0, **RUN)
    if die == "published":  # its rows are in the table, so it has loaded the file
        assert (result.status, log(spark, root)) == ("skipped", {1: ("completed", 4), 2: ("completed", 3), 3: ("skipped", 0)})
        assert stored(spark, root) == [1, 2, 3, 4, 5, 6, 7]
    else:
        assert (result.status, log(spark, root)) == ("completed", {1: ("failed", 0), 2: ("completed", 3), 3: ("completed", 4)})
        assert stored(spark, root) == [5, 6, 7, 8, 9, 10, 11]
    left = [n for n in files.names(spark, root) if n.startswith("staged")] + [n for n in files.names(spark, f"{root}/raw") if n.startswith("__version=1-")]
    assert len(left) == (die == "published")


def test_a_load_taken_for_dead_publishes_nothing(spark, tmp_path, monkeypatch):
    """It comes back after another run has ended it: its rows stay out, and the file is there once."""
    root, path = str(tmp_path / "lake"), month(tmp_path, "m.parquet", 4)
    real, results = raw.stage_raw, []

    def slow(t, i, p):
        out = real(t, i, p)
        if i == 1:
            monkeypatch.setattr(ingest, "stage_raw", real)
            monkeypatch.setattr(audit, "is_alive", lambda s, p, i, lease: i != 1)
            results.append(ingest.ingest(spark, path, root=root, **RUN))
        return out

    monkeypatch.setattr(ingest, "stage_raw", slow)
    with pytest.raises(raw.Fenced):
        ingest.ingest(spark, path, root=root, **RUN)
    assert results[0].status == "completed" and stored(spark, root) == [5, 6, 7, 8]
    assert log(spark, root) == {1: ("failed", 0), 2: ("completed", 4)}
