"""A load whose file is one large row group, as publishers give them: no task sorts it."""

import pyarrow as pa
import pyarrow.parquet as pq

from tests.test_prepare import ROW
from tripmart.sources import ingest, parquet, raw, tables


def _plans(spark) -> list[str]:
    """Plans of all statements of the session so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(k).physicalPlanDescription() for k in range(found.size())]


def _ids(path: str) -> list[list[int]]:
    """Trip ids of each file as they lie there."""
    from pathlib import Path

    return [pq.ParquetFile(f).read(["raw_trip_id"]).column(0).to_pylist() for f in sorted(Path(path).rglob("*.parquet"))]


def test_a_load_is_not_sorted(spark, tmp_path, monkeypatch):
    n, root = 20_000, str(tmp_path / "lake")
    monkeypatch.setattr(ingest, "ROW_GROUP_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(tables, "ROW_GROUP_BYTES", 1 << 16)
    table = pa.table({k: [v] * n for k, v in ROW.items()} | {"fare_amount": [k / 7 for k in range(n)], "total_amount": [k / 3 for k in range(n)]})
    pq.write_table(table, tmp_path / "month.parquet")
    assert ingest.ingest(spark, str(tmp_path / "month.parquet"), "yellow", 2025, 1, root).rows_loaded == n
    writes = [p for p in _plans(spark) if f"{root}/raw/__version" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert writes and not any("Sort" in p for p in writes)
    files_ = _ids(f"{root}/raw")
    assert sorted(k for ids in files_ for k in ids) == list(range(1, n + 1)) and all(ids == sorted(ids) for ids in files_)
    part = tables.current(spark, f"{root}/raw").parts["ingestion_id=1"]
    folder = f"{root}/raw/{part['folder']}"
    assert part["rows"] == n and parquet.row_groups(spark, f"{folder}/ingestion_id=1").count() > 1
    assert [r.fare_amount for r in raw.raw_trips(spark, f"{root}/raw").where("raw_trip_id = 7 AND ingestion_id = 1").collect()] == [6 / 7]
    raw.delete_ingestion(spark, f"{root}/raw", 1)
    tables.vacuum(spark, f"{root}/raw", 0)  # finished folders that no version names go
    assert not (tmp_path / "lake" / "raw" / part["folder"]).exists()


def test_append_in_any_order_and_empty(spark, tmp_path):
    place = str(tmp_path / "raw")
    t = spark.range(1, 101, numPartitions=2).selectExpr("101 - id AS raw_trip_id", "id AS v")
    assert raw.append_raw(t, 4, place) == 100 and raw.append_raw(t.limit(0), 5, place) == 0
    assert list(tables.current(spark, place).parts) == ["ingestion_id=4"]
    assert all(ids == sorted(ids) for ids in _ids(place)) and raw.raw_trips(spark, place, 4).count() == 100
