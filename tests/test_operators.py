import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import aggregates, evaluate, folds, joins, reshape, stationary, windows
from seriesloom.plans import bindings as b
from seriesloom.sources import literals, panels


def series(spark, values, first=0, entity="a"):
    return spark.createDataFrame([(entity, first + i, v) for i, v in enumerate(values)], "entity string, period int, value double")


def column(frame, name):
    return [r[name] for r in frame.orderBy("period").collect()]


def test_impute_modes(spark):
    panel = series(spark, [None, 10.0, None, 13.0, None, 12.5, None, None, 10.0, None])
    mean = column(reshape.impute_neighbours(panel, ["entity"]), "value")
    assert mean == [None, 10.0, 11.5, 13.0, 12.75, 12.5, 11.25, 11.25, 10.0, None]
    steps = column(reshape.impute_neighbours(series(spark, [10.0, None, 13.0, None, 10.0, None, 12.5]), ["entity"], mode="sequence"), "value")
    assert steps == [10.0, 11.5, 13.0, 11.5, 10.0, 11.0, 12.5]


def test_complete_periods(spark):
    panel = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("b", 0, 3.0)], "entity string, period int, value double")
    full = reshape.complete_periods(panel, ["entity"], 0, 6)
    assert full.count() == 14
    assert column(full.filter("entity = 'a'"), "value") == [None, None, 1.0, None, None, 2.0, None]
    assert column(full.filter("entity = 'b'"), "value") == [3.0] + [None] * 6


@pytest.mark.parametrize(
    "code, expected",
    [
        (1, [1, 2, 4, 8]), (2, [None, 1, 2, 4]), (3, [None, None, 1, 2]), (4, [0, math.log(2), math.log(4), math.log(8)]),
        (5, [None] + [100 * math.log(2)] * 3), (6, [None, None, 0, 0]), (7, [None, None, 0, 0]),
    ],
)
def test_transform_codes(spark, code, expected):
    codes = spark.createDataFrame([("a", code)], "series string, code int")
    got = column(stationary.make_stationary(series(spark, [1.0, 2.0, 4.0, 8.0]), codes, ["entity"], "entity"), "stationary")
    assert [g if g is None else round(g, 9) for g in got] == [e if e is None else round(e, 9) for e in expected]


def test_transform_of_non_positive_values_is_null(spark):
    codes = spark.createDataFrame([("a", 5)], "series string, code int")
    got = column(stationary.make_stationary(series(spark, [1.0, 0.0, -2.0, 4.0]), codes, ["entity"], "entity"), "stationary")
    assert got == [None, None, None, None]


def test_growth_of_zero_and_gap(spark):
    panel = series(spark, [0.0, 5.0, None, 10.0]).withColumn("g", windows.growth("value", ["entity"]))
    assert column(panel, "g") == [None, None, None, None]


def test_regime_boundaries(spark):
    periods = [8004, 8005, 8007, 8008]  # 2001 Q1, Q2, Q4 and 2002 Q1
    frame = spark.createDataFrame([(p,) for p in periods], "period int")
    assert column(joins.regime_join(frame, literals.recessions(spark)), "in_regime") == [False, True, True, False]


def test_overlapping_regimes_do_not_multiply_rows(spark):
    regimes = spark.createDataFrame([(1, 0, 5), (2, 3, 8)], "regime_id int, start int, end int")
    frame = spark.createDataFrame([(p,) for p in range(10)], "period int")
    out = joins.regime_join(frame, regimes)
    assert out.count() == 10 and column(out, "regime_id") == [1] * 6 + [2] * 3 + [None]


def test_regime_join_is_a_hash_join(spark, data):
    plan = joins.regime_join(b.nation_q(spark, data), literals.recessions(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_date_slice_reaches_the_scan(spark, data):
    rows = reshape.date_slice(b.table(spark, data, "orders"), "o_orderdate", 7990, 7993).select("o_orderkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_lags_share_one_shuffle_after_aggregation(spark, data):
    frame = windows.lag_frame(b.flag_m(spark, data), ["entity"], "revenue", ["quantity", "discount"], 4, 2)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # aggregation by cell, then by series


@pytest.mark.parametrize("accuracy", [40, 200, 100_000])
def test_exact_percentiles_in_every_regime(spark, accuracy):
    """Small accuracies force the bracketed path, with ties and a dominant group."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(size=6000)] + [("hot", 0.25)] * 2000 + [("b", float(i)) for i in range(7)] + [("c", 5.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q100": 1.0}
    got = {r["g"]: r for r in aggregates.exact_percentiles(frame, ["g"], "v", probs, accuracy).collect()}
    for g in ("hot", "b", "c"):
        values = np.array([v for k, v in rows if k == g])
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-12), (g, name)


def test_top_with_ties_keeps_all_ties(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([1, 2, 2, 2, 3])] + [("b", i, 7.0) for i in range(50)]
    frame = spark.createDataFrame(rows, "g string, id int, v double")
    low = windows.top_with_ties(frame, ["g"], "v", 2).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in low} == {"a": 4, "b": 50}
    high = windows.top_with_ties(frame, ["g"], "v", 1, smallest=False).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in high} == {"a": 1, "b": 50}


def test_folds_match_the_textbook(spark):
    panel = series(spark, [float(i) for i in range(60)])
    rows = folds.fold_rows(panel, ["entity"], go_back=51, skip=10).collect()
    tests = sorted((r["fold"], r["period"]) for r in rows if r["role"] == "test")
    assert tests == [(i + 1, 9 + 10 * i) for i in range(6)]
    for fold, test in tests:
        assert sorted(r["period"] for r in rows if r["fold"] == fold and r["role"] == "train") == list(range(test))
    gapped = folds.fold_rows(panel, ["entity"], go_back=51, skip=10, gap=3).filter("role = 'train' AND fold = 2").agg(F.max("period")).first()[0]
    assert gapped == 15


def test_origin_rows_expand(spark):
    out = joins.origin_rows(series(spark, [1.0, 2.0, 3.0, 4.0]), 1, 2)
    assert sorted((r["origin"], r["period"]) for r in out.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_validate_panel(spark):
    frame = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("a", 4), ("b", 3)], "entity string, period int")
    got = {r["entity"]: (r["n_rows"], r["n_duplicated"], r["n_gaps"]) for r in reshape.validate_panel(frame, ["entity"]).collect()}
    assert got == {"a": (4, 1, 1), "b": (1, 0, 0)}


def test_metadata_rows_from_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("sasdate,GDPC1,UMCSENTx\nfactors,1,0\ntransform,5,2\n3/1/1999,10.5,\n6/1/1999,11.5,80.1\n")
    meta, rows = panels.split_metadata_rows(panels.read_wide_csv(spark, str(path), ["sasdate", "GDPC1", "UMCSENTx"]))
    assert {r["series"]: (r["factors"], r["code"]) for r in meta.collect()} == {"GDPC1": (1, 5), "UMCSENTx": (0, 2)}
    assert [tuple(r) for r in rows.orderBy("period").collect()] == [(7996, 10.5, None), (7997, 11.5, 80.1)]


def test_drop_leading_columns(spark):
    sheet = spark.createDataFrame([(1, 2, 3, "1999Q1", 5.0, 6.0)], ["a", "b", "c", "d", "e", "f"])
    assert panels.drop_leading_columns(sheet, 3, ["DATE_QUARTER", "NOMINAL_GDP", "REAL_GDP"]).first() == ("1999Q1", 5.0, 6.0)


def test_dm_forms_agree_without_adjustment(spark, data):
    """The adjusted statistic is the plain one times the small-sample factor."""
    from seriesloom.plans.evaluation import PAIRS, records

    rows = records(spark, data)
    on = ["entity", "horizon", "model", "benchmark"]
    plain = evaluate.dm_statistic(rows, ["entity"], PAIRS, 2, False).select(*on, "n", "periods_ahead", F.col("statistic").alias("s"))
    both = plain.join(evaluate.dm_statistic(rows, ["entity"], PAIRS, 2, True).select(*on, "statistic"), on).filter("s IS NOT NULL").collect()
    assert both
    for r in both:
        n, h = r["n"], r["periods_ahead"]
        inner = (n + 1 - 2 * h + h * (h - 1) / n) / n
        if inner > 0:
            assert r["statistic"] == pytest.approx(r["s"] * math.sqrt(inner))


def test_stage_survives_and_prunes(spark, data):
    staged = panels.stage(b.flag_m(spark, data).withColumn("model_id", F.col("entity")), "test-stage", ["model_id"])
    assert staged.filter("model_id = 'A'").count() == 83
    plan = staged.filter("model_id = 'A'").select("revenue")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_id" in plan
