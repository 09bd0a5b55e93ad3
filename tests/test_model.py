import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tripmart.operators import series
from tripmart.operators.compare import check_grain, diff_rows, expectations, orphans, reconcile_totals, symmetric_difference
from tripmart.operators.upsert import upsert


def test_windows(spark):
    rows = [(7, d, n) for d, n in ((1, 4), (2, 0), (4, 4), (5, 2))]
    t = spark.createDataFrame(rows, "ingestion_id long, day int, trip_count long")
    w = series.ordered("day")
    before = series.previous("trip_count", w)
    out = t.select("day", before, series.running_sum("trip_count", w), series.rolling_mean("trip_count", w, 3), series.demand_rank("trip_count"), series.percent_change(F.col("trip_count"), before), series.share("trip_count")).orderBy("day").collect()
    D = Decimal
    assert [tuple(r) for r in out] == [
        (1, None, 4, D("4.00"), 1, None, D("40.0000")),
        (2, 4, 4, D("2.00"), 4, D("-100.00"), D("0.0000")),
        (4, 0, 8, D("2.67"), 1, None, D("40.0000")),
        (5, 4, 10, D("2.00"), 3, D("-50.00"), D("20.0000")),
    ]


def test_upsert_keeps_surrogates_and_null_member(spark):
    first = upsert(None, spark.createDataFrame([(2, "b"), (None, "missing")], "code int, name string"), ["code"], "k")
    assert {(r.k, r.code) for r in first.collect()} == {(1, 2), (2, None)}
    again = upsert(first, spark.createDataFrame([(2, "B"), (1, "a"), (None, "none")], "code int, name string"), ["code"], "k")
    assert {tuple(r) for r in again.collect()} == {(1, 2, "B"), (2, None, "none"), (3, 1, "a")}
    kept = upsert(again, spark.createDataFrame([(9, "z")], "code int, name string"), ["code"], "k")
    assert kept.count() == 4
    fact = upsert(spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "Y"), (3, "z")], "id int, v string"), ["id"])
    assert {tuple(r) for r in fact.collect()} == {(1, "x"), (2, "Y"), (3, "z")}


def test_checks_find_injected_defects(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (2, 20)], "k int, n int")
    b = spark.createDataFrame([(1, 11), (3, 30)], "k int, n int")
    assert [tuple(r) for r in check_grain(a, ["k"]).collect()] == [(2, 2)]
    d = a.distinct()
    assert {tuple(r) for r in reconcile_totals(d, b, ["k"], ["n"]).collect()} == {(1, 1, None), (2, None, "actual"), (3, None, "expected")}
    assert {tuple(r) for r in reconcile_totals(d, b, ["k"], ["n"], fill=True).collect()} == {(1, 1, None), (2, -20, "actual"), (3, 30, "expected")}
    assert {tuple(r) for r in diff_rows(d, b, ["k"], ["n"]).collect()} == {(1, None), (2, "actual"), (3, "expected")}
    assert diff_rows(d, d, ["k"], ["n"]).count() == 0
    assert symmetric_difference(d, b).count() == 4
    assert [r.k for r in orphans(b, a, "k").collect()] == [3]
    assert {tuple(r) for r in expectations(a, {"small": F.col("n") < 15, "any": F.col("n") > 0}).collect()} == {("small", 2), ("any", 0)}


def test_layers_agree(spark):
    from tests.conftest import SF
    from tripmart.plans import marts, validation
    from tripmart.queries import Model

    m = Model(spark, SF)
    assert diff_rows(marts.daily_summary(m.daily), marts.daily_summary(m.fact_daily()), ["ingestion_id", "pickup_date"], ["trip_count"]).count() > 0  # trips without dropoff stay out of the fact
    assert validation.daily_windows(marts.daily_summary(m.daily)).count() == 0
    assert {r.difference_count for r in validation.categorical_differences(m.staging, m.dims).collect()} == {0}
    assert {r.mismatch_count for r in validation.preserved_columns(m.staging, m.fact).collect()} == {0}
    assert m.fact.columns[0] == "raw_trip_id" and len(m.fact.columns) == 49 and len(m.staging.columns) == 56
    assert m.dims["dim_date"].where(F.col("full_date") == dt.date(2024, 1, 6)).first().is_weekend


def test_dimensions_beyond_the_bound_give_the_same_fact(spark, monkeypatch):
    from tests.conftest import SF
    from tripmart.plans import star
    from tripmart.queries import Model

    held = Model(spark, SF)
    want = sorted(map(str, held.fact.collect()))
    assert all(d._jdf.queryExecution().logical().toString().startswith("ResolvedHint") or "UnresolvedHint" in d._jdf.queryExecution().logical().toString() for d in held.dims.values())
    monkeypatch.setattr(star, "SMALL", 0)
    assert sorted(map(str, Model(spark, SF).fact.collect())) == want


def test_a_limit_that_the_session_sets_stays(spark):
    from tripmart.plans.session import LIMIT, jit_sized

    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "20000")
        jit_sized(spark)
        assert spark.conf.get(LIMIT) == "20000"
        spark.conf.unset(LIMIT)
        jit_sized(spark)
        assert spark.conf.get(LIMIT) == "8000"
    finally:
        spark.conf.set(LIMIT, before)
