"""Upserts into partitions: the source is computed once, and whole old rows move only where some stay."""

import pytest
from pyspark.sql import functions as F

from tripmart.sources import files, tables


def rows(spark, place):
    return sorted(map(tuple, tables.read_table(spark, place).collect()))


@pytest.mark.parametrize("kept", [0, 3])
def test_source_is_computed_once(spark, tmp_path, kept):
    place, seen = str(tmp_path / "fact"), spark.sparkContext.accumulator(0)
    tables.save_table(spark.range(20 + kept).selectExpr("id", "'old' AS v", "id % 2 AS p"), place, ["p"], ["id"])

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = spark.range(0, 20, 2, 2).selectExpr("id", "'new' AS v", "id % 2 AS p").mapInArrow(counted, "id long, v string, p long")
    before = tables.current(spark, place).parts
    tables.upsert_table(source, place, ["id"], ["p"], ["id"])
    assert seen.value == 10  # each row once
    assert rows(spark, place) == [(k, "old" if k % 2 or k >= 20 else "new", k % 2) for k in range(20 + kept)]
    after = tables.current(spark, place).parts
    assert after["p=1"] == before["p=1"] and "_SUCCESS" in files.names(spark, f"{place}/{after['p=0']['folder']}")


def test_null_keys_types_and_conflicts_leave_no_trace(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "fact")
    tables.save_table(spark.createDataFrame([(None, 1, "a"), (2, 1 << 40, "a"), (3, 3, None)], "`odd id` long, v long, p string"), place, ["p"])
    narrow = spark.createDataFrame([(None, 5, "a")], "`odd id` int, v int, p string")
    tables.upsert_table(narrow, place, ["odd id"], ["p"])
    t = tables.read_table(spark, place)
    assert t.dtypes[:2] == [("odd id", "bigint"), ("v", "bigint")]
    assert sorted(map(str, t.collect())) == sorted(map(str, spark.createDataFrame([(None, 5, "a"), (2, 1 << 40, "a"), (3, 3, None)], t.schema).collect()))
    seen, real = [], tables.write

    def watched(*args, **options):
        w = real(*args, **options)
        tables.vacuum(spark, place, 0)  # another writer cleans up while this one is not done
        seen.append("_SUCCESS" in files.names(spark, f"{place}/{w.folder}"))
        return w

    monkeypatch.setattr(tables, "write", watched)
    tables.upsert_table(narrow.withColumn("v", F.lit(6)), place, ["odd id"], ["p"])
    assert seen == [False] and sorted(r.v for r in tables.read_table(spark, place).collect()) == [3, 6, 1 << 40]
