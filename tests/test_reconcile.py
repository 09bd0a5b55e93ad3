"""Digests, bitmaps and one-pass statistics against plain counterparts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmart.operators.distinct import distinct_ids, repeated_rows
from tripmart.operators.quantiles import column_statistics
from tripmart.operators.reconcile import differing, mismatches, missing_keys

KIND = "k long, a double, b string, c int, d boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def made(n=3000):
    rng = random.Random(1)
    return [(k, rng.choice([None, 0.5, -1.25]), rng.choice([None, "x", "y"]), rng.choice([None, 0, 1]), rng.random() < 0.5) for k in range(-200, n)]


@pytest.mark.parametrize("width", [1, 64, 100_000])
def test_mismatches(spark, width):
    rows = made()
    changed = {10: {1: 9.0}, 11: {2: None}, 700: {1: None, 3: 5}, 701: {4: None}, -5: {2: "z"}}
    other = [tuple(changed.get(r[0], {}).get(i, v) for i, v in enumerate(r)) for r in rows if r[0] not in (20, 21, 2900)]
    e, a = table(spark, [*rows, (None, 1.0, "n", 1, True)]), table(spark, [*other, (5000, 1.0, "more", 1, True)])
    want = {c: 0 for c in "abcd"}
    for r, o in ((r, o) for r in rows for o in other if r[0] == o[0]):
        for i, c in enumerate("abcd", 1):
            want[c] += r[i] != o[i]
    assert {r.column_name: r.mismatch_count for r in mismatches(e, a, "k", list("abcd"), width).collect()} == want
    assert tuple(missing_keys(e, a, "k", "m", "x", width).first()) == (4, 1)
    assert {r.column_name: r.mismatch_count for r in mismatches(e, e, "k", list("abcd"), width).collect()} == dict.fromkeys("abcd", 0)
    if width == 64:
        some, _ = differing(e, a, "k", list("abcd"), width)
        assert 0 < some.count() <= 6 * 64  # only buckets with a change
        assert [t.count() for t in differing(e, e.repartition(7), "k", list("abcd"), width)] == [0, 0]


def test_hashes_tell_nulls_and_places_apart(spark):
    pairs = [((1, None, "x", None, None), (1, None, None, None, None)), ((1, 0.0, "", 0, False), (1, None, None, None, None)), ((1, None, "x", 1, True), (1, 1.0, "x", None, True))]
    for one, two in pairs:
        assert sum(r.mismatch_count for r in mismatches(table(spark, [one]), table(spark, [two]), "k", list("abcd")).collect()) == sum(x != y for x, y in zip(one, two))
    assert sum(r.mismatch_count for r in mismatches(table(spark, [(1, 0.0, "", 0, False)]), table(spark, [(1, -0.0, "", 0, False)]), "k", list("abcd")).collect()) == 0
    with pytest.raises(ValueError):
        mismatches(spark.range(3).withColumn("v", F.lit(1)), spark.range(3).withColumn("v", F.lit("1")), "id", ["v"])


def test_distinct_ids(spark):
    rows = [(k % 3, i) for k, i in enumerate([*range(100_000, 170_000), *range(100_000, 100_500), -1, -1, 0, None, None, 2**40])]
    t = spark.createDataFrame(rows, "g int, id long").repartition(4)
    want = {(r.g, r.n, r.d) for r in t.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).collect()}
    assert {tuple(r) for r in distinct_ids(t, ["g"], "id").collect()} == want
    assert tuple(distinct_ids(t, [], "id").first()) == (len(rows), len({i for _, i in rows if i is not None}))
    assert tuple(distinct_ids(t.limit(0), [], "id").first()) == (0, 0)


def test_repeated_rows(spark):
    rows = made(500)
    planted = [rows[3]] * 4 + [(None, None, None, None, None)] * 3 + [(1, float("nan"), "x", 1, True)] * 2 + [(1, 0.0, "x", 1, True), (1, -0.0, "x", 1, True)]
    t = table(spark, rows + planted)
    got = repeated_rows(t, ["k", "a", "b", "c", "d"])
    assert got.first()[0] == 4 + 2 + 1 + 1
    assert repeated_rows(t, ["b", "c"]).first()[0] == len(rows + planted) - 9
    assert repeated_rows(t.limit(0), ["b"]).first()[0] == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__a" in plan and "keys=[__a" in plan


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_column_statistics(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 9, n).astype(float), rng.normal(0, 100, n)
    rows = [(float(a), float(b), None) for a, b in zip(x, y)] + [(None, None, None)] * 3
    t = spark.createDataFrame(rows, "x double, `y.z` double, none double").repartition(5)
    got = {r.column_name: r for r in column_statistics(t, ["x", "y.z", "none"], {"q10": 0.1, "q50": 0.5, "q99": 0.99}).collect()}
    for name, v in (("x", x), ("y.z", y)):
        r = got[name]
        assert r.n == n and (r.min, r.max) == (v.min(), v.max()) and math.isclose(r.mean, v.mean(), abs_tol=1e-9)
        assert all(math.isclose(r[q], np.quantile(v, s), rel_tol=1e-12, abs_tol=1e-12) for q, s in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)))
        assert r["std"] is None if n == 1 else math.isclose(r["std"], v.std(ddof=1), rel_tol=1e-9)
    assert tuple(got["none"])[1:] == (0, *[None] * 7)
