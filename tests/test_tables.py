"""Versioned tables: readers and writers at the same time, partitions, and point queries."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tripmart.sources import files, parquet, tables


def test_a_file_is_created_once_and_whole(spark, tmp_path):
    place = str(tmp_path / "deep" / "x.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.publish(spark, place, f"{k}" * 1000), range(16)))
    assert sum(won) == 1 and files.read(spark, place) == f"{won.index(True)}" * 1000
    assert files.names(spark, str(tmp_path / "deep")) == ["x.json"] and files.names(spark, str(tmp_path / "none")) == []
    with pytest.raises(FileNotFoundError):
        files.read(spark, str(tmp_path / "none"))


def test_readers_see_whole_versions_during_50_replacements(spark, tmp_path):
    place = str(tmp_path / "table")
    tables.save_table(spark.range(20).withColumn("v", F.lit(0)).repartition(3), place)
    over, seen, failed = threading.Event(), [], []

    def read():
        while not over.is_set():
            try:
                seen.append([tuple(r) for r in tables.read_table(spark, place).groupBy("v").count().collect()])
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    readers = [threading.Thread(target=read) for _ in range(2)]
    for r in readers:
        r.start()
    for k in range(1, 51):
        tables.save_table(spark.range(20 + k).withColumn("v", F.lit(k)).repartition(3), place)
    over.set()
    for r in readers:
        r.join()
    assert not failed and len(seen) > 20
    assert all(len(rows) == 1 and rows[0][1] == 20 + rows[0][0] for rows in seen)
    assert tables.read_table(spark, place).count() == 70
    tables.vacuum(spark, place, 0)
    assert len([n for n in files.names(spark, place) if n.startswith("__version")]) == 1 and tables.read_table(spark, place).count() == 70


def test_failed_writer_leaves_the_old_version(spark, tmp_path):
    place = str(tmp_path / "table")
    tables.save_table(spark.range(3), place)
    with pytest.raises(Exception, match="no such row"):
        tables.save_table(spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("no such row"))).alias("id")), place)
    assert tables.read_table(spark, place).count() == 3 and tables.current(spark, place).number == 1
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none"))


def rows(spark, place):
    return sorted(tuple(r) for r in tables.read_table(spark, place).collect())


def test_upsert_touches_one_partition(spark, tmp_path):
    place = str(tmp_path / "fact")
    kind = "id long, v string, month string, `odd name` int"
    start = [(k, "old", m, None if k % 2 else 1) for k, m in enumerate(["jan", "feb", "a/b=c {x}"] * 10)]
    tables.save_table(spark.createDataFrame(start, kind), place, ["month", "odd name"])
    before = tables.current(spark, place).parts
    assert len(before) == 6 and rows(spark, place) == sorted((k, v, m, o) for k, v, m, o in start)
    new = [(5, "new", "a/b=c {x}", None), (99, "new", "a/b=c {x}", None)]
    source = spark.createDataFrame(new, kind)
    assert tables.upsert_table(source, place, ["id"], ["month", "odd name"]).number == 2
    after = tables.current(spark, place).parts
    changed = [p for p in after if after[p] != before.get(p)]
    assert len(changed) == 1 and set(after) == set(before)
    want = sorted([r for r in start if r[0] != 5] + new)
    assert rows(spark, place) == want
    tables.upsert_table(spark.createDataFrame([(7, "x", "mar", None)], kind), place, ["id"], ["month", "odd name"])
    assert rows(spark, place) == sorted([*want, (7, "x", "mar", None)])
    tables.upsert_table(source.limit(0), place, ["id"], ["month", "odd name"])
    assert len(rows(spark, place)) == 32


def test_two_upserts_at_once(spark, tmp_path, monkeypatch):
    """Of different partitions both come through; of one, the second is told."""
    place = str(tmp_path / "fact")
    t = lambda *r: spark.createDataFrame(list(r), "id int, v int, p int")
    tables.save_table(t((1, 1, 1), (2, 2, 2)), place, ["p"])
    real, between = tables.write, []

    def interrupted(*args, **options):
        out = real(*args, **options)
        if between:
            between.pop()()
        return out

    monkeypatch.setattr(tables, "write", interrupted)
    between.append(lambda: tables.upsert_table(t((2, 20, 2)), place, ["id"], ["p"]))
    tables.upsert_table(t((1, 10, 1)), place, ["id"], ["p"])
    assert rows(spark, place) == [(1, 10, 1), (2, 20, 2)]
    between.append(lambda: tables.upsert_table(t((1, 11, 1)), place, ["id"], ["p"]))
    with pytest.raises(tables.Conflict):
        tables.upsert_table(t((1, 12, 1)), place, ["id"], ["p"])
    assert rows(spark, place) == [(1, 11, 1), (2, 20, 2)]


def _scan(df) -> dict:
    """Metrics of the scan of a collected query."""
    plan = df._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet"):
            m = node.metrics()
            return {k: m.apply(k).value() for k in ("numOutputRows", "numFiles")}
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
    raise AssertionError(plan.toString())


def test_point_query_reads_one_row_group(spark, tmp_path, monkeypatch):
    """3.5 million rows in several files: the statistics of sorted ids leave one small group of rows to be read."""
    place = str(tmp_path / "fact")
    monkeypatch.setattr(tables, "ROW_GROUP_BYTES", 1 << 20)
    n = 3_500_000
    t = spark.range(0, n, numPartitions=4).select(F.col("id").alias("raw_trip_id"), (F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 2).alias("ingestion_id"))
    tables.save_table(t, place, ["ingestion_id"], ["raw_trip_id"])
    one = tables.read_table(spark, place).where("raw_trip_id = 1234567 AND ingestion_id = 1")
    assert [tuple(r) for r in one.collect()] == [(1234567, 1234567 * 7 % 1000, 1)]
    folder = f"{place}/{tables.current(spark, place).parts['ingestion_id=1']['folder']}/ingestion_id=1"
    groups = [r.rows for r in parquet.row_groups(spark, folder).collect()]
    assert len(groups) >= 8 and 0 < _scan(one)["numOutputRows"] <= max(groups) < n / 10  # one group at most
    absent = tables.read_table(spark, place).where("raw_trip_id = 1234568 AND ingestion_id = 1")
    assert absent.collect() == [] and _scan(absent)["numOutputRows"] == 0  # between two ids of that partition: the Bloom filter knows
