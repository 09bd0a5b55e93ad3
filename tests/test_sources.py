from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_prepare import ROW
from tripmart.plans.validation import verify_ingestion
from tripmart.sources import audit, files, ingest, parquet, raw, tables


@pytest.fixture
def month(tmp_path):
    table = pa.table({k: [v] * 3 for k, v in ROW.items()})
    pq.write_table(table, tmp_path / "month.parquet", row_group_size=2)
    return str(tmp_path / "month.parquet")


RUN = dict(taxi_type="yellow", period_year=2025, period_month=1)


def test_manifest_and_errors(spark, month, tmp_path):
    row = parquet.parquet_manifest(spark, month).first()
    assert (row.rows, row.columns, row.row_groups) == (3, 20, 2) and row.file_size_bytes > 0
    assert parquet.read_trips(spark, month, ["VendorID"]).columns == ["VendorID"]
    with pytest.raises(FileNotFoundError):
        parquet.check_file(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError, match="not a file"):
        parquet.check_file(spark, str(tmp_path))
    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(ValueError, match="not a Parquet"):
        parquet.check_file(spark, str(tmp_path / "x.csv"))


def test_row_groups(spark, tmp_path):
    path = str(tmp_path / "groups.parquet")
    pq.write_table(pa.table({"id": pa.array(range(7), pa.int32()), "odd name": [f"t{k}" for k in range(7)]}), path, row_group_size=3)
    assert [(r.row_group, r.rows, r.columns) for r in parquet.row_groups(spark, path).orderBy("row_group").collect()] == [(0, 3, 2), (1, 3, 2), (2, 1, 2)]
    one = parquet.read_row_groups(spark, path, [1])
    assert one.dtypes == [("row_group", "int"), ("id", "int"), ("odd name", "string")]
    assert sorted(map(tuple, one.collect())) == [(1, 3, "t3"), (1, 4, "t4"), (1, 5, "t5")]
    every = parquet.read_row_groups(spark, path, columns=["odd name"])
    assert sorted(map(tuple, every.collect())) == [(k // 3, f"t{k}") for k in range(7)] and every.rdd.getNumPartitions() == 3
    assert parquet.read_row_groups(spark, path, []).count() == 0
    for k in (3, -1):
        with pytest.raises(IndexError, match="outside the valid range"):
            parquet.read_row_groups(spark, path, [k])
    with pytest.raises(FileNotFoundError):
        parquet.read_row_groups(spark, str(tmp_path / "none.parquet"))


def test_ingest_once_then_skip(spark, month, tmp_path):
    root = str(tmp_path / "lake")
    first = ingest.ingest(spark, month, root=root, **RUN)
    second = ingest.ingest(spark, month, root=root, **RUN)
    assert (first.status, first.rows_loaded, second.status) == ("completed", 3, "skipped")
    log = {r.ingestion_id: r.status for r in audit.audit_log(spark, f"{root}/audit").collect()}
    assert log == {first.ingestion_id: "completed", second.ingestion_id: "skipped"}
    stored = raw.raw_trips(spark, f"{root}/raw", first.ingestion_id)
    assert sorted(r.raw_trip_id for r in stored.collect()) == [1, 2, 3]
    assert "PartitionFilters: [isnotnull(ingestion_id" in stored._jdf.queryExecution().toString()
    size = parquet.parquet_manifest(spark, month).first().file_size_bytes
    checks = verify_ingestion(parquet.parquet_manifest(spark, month), audit.audit_log(spark, f"{root}/audit"), raw.raw_trips(spark, f"{root}/raw"), "month.parquet", size, first.ingestion_id)
    assert [r.passed for r in checks.collect()] == [True] * 7
    assert raw.delete_ingestion(spark, f"{root}/raw", first.ingestion_id) == 3
    assert raw.delete_ingestion(spark, f"{root}/raw", first.ingestion_id) == 0


def test_failure_cleans_up_and_is_raised(spark, month, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    monkeypatch.setattr(ingest, "stage_raw", lambda t, i, p: raw.stage_raw(t.limit(2), i, p))
    with pytest.raises(ValueError, match="footer 3, read 3, loaded 2"):
        ingest.ingest(spark, month, root=root, **RUN)
    row = audit.audit_log(spark, f"{root}/audit").first()
    assert row.status == "failed" and "loaded 2" in row.error_message and row.rows_loaded == 0
    assert not [n for n in files.names(spark, f"{root}/raw") if n != "_versions"] and not [n for n in files.names(spark, root) if n.startswith("staged")]
    with pytest.raises(RuntimeError):
        audit.complete_ingestion(spark, f"{root}/audit", 99, 1, 1)
    with pytest.raises(ValueError):
        verify_ingestion(None, None, None, "month.parquet", 1, None)
    monkeypatch.undo()
    again = ingest.ingest(spark, month, root=root, **RUN)
    assert (again.status, again.ingestion_id) == ("completed", 2)
    assert sorted(r.raw_trip_id for r in raw.raw_trips(spark, f"{root}/raw").collect()) == [4, 5, 6]  # the failed run leaves a gap


def test_ids_are_claimed_once(spark, tmp_path):
    log = str(tmp_path / "audit")
    run = dict(source_file_name="x", file_size_bytes=1, **RUN)
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda k: audit.start_ingestion(spark, log, rows=10 + k, **run), range(16)))
    assert sorted(ids) == list(range(1, 17))
    ranges = sorted(audit.trip_ids(spark, log, i) for i in ids)
    assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges[:-1], ranges[1:])) and ranges[-1][1] == sum(10 + k for k in range(16))


def test_compaction_of_the_log(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "audit")
    run = dict(source_file_name="x", file_size_bytes=1, **RUN)
    for k in range(6):
        i = audit.start_ingestion(spark, log, rows=10, **run)
        if k != 4:
            audit.complete_ingestion(spark, log, i, 10, 10)
    audit.record_skipped(spark, log, **run)
    state = lambda: {r.ingestion_id: (r.status, r.rows_read, r.completed_at is None) for r in audit.audit_log(spark, log).collect()}
    before = state()
    assert not audit.compact(spark, log, every=5) and audit.compact(spark, log, every=4)
    assert state() == before and [n for n in files.names(spark, f"{log}/events")] == ["000000000005-0.json", "000000000006-0.json", "000000000006-1.json", "000000000007-0.json"]
    read = []
    real = files.read
    monkeypatch.setattr(files, "read", lambda s, p: read.append(p) or real(s, p))
    audit.audit_log(spark, log)
    assert sum("events" in p for p in read) == 4  # only what is behind the table
    audit.fail_ingestion(spark, log, 5, "late")
    assert audit.compact(spark, log, every=1) and files.names(spark, f"{log}/events") == []
    assert state() == before | {5: ("failed", 0, False)}
    new = audit.start_ingestion(spark, log, rows=3, **run)
    assert new == 8 and audit.trip_ids(spark, log, new) == (60, 63)
    with pytest.raises(audit.Ended):
        audit.complete_ingestion(spark, log, new, 1, 1) or audit.complete_ingestion(spark, log, new, 1, 1)


def test_sample_save_and_ids(spark, tmp_path):
    t = spark.range(100).withColumn("v", F.col("id") * 2)
    once, twice = (sorted(r.id for r in parquet.sample_trips(t, 10).collect()) for _ in range(2))
    assert once == twice and len(once) == 10
    for n in (1, 2):
        tables.save_table(t.limit(n), str(tmp_path / "table"))
        assert tables.read_table(spark, str(tmp_path / "table")).count() == n
    t.repartition(7).write.parquet(str(tmp_path / "ids"))
    ids = raw.assign_trip_ids(spark.read.parquet(str(tmp_path / "ids")), 50)
    assert sorted(r.raw_trip_id for r in ids.collect()) == list(range(51, 151))
    parquet.register_views({"some_view": t})
    assert spark.sql("SELECT count(*) FROM some_view").first()[0] == 100
