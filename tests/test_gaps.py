"""Holes, short series and NULL groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import aggregates, diagnostics, factors, ml, systems, windows


def panel(spark, lengths, columns=2, hole=None, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for entity, n in lengths.items():
        x = rng.normal(size=(n, columns)).cumsum(0)
        rows += [(entity, 100 + t, *map(float, x[t])) for t in range(n) if t != hole]
    names = ", ".join(f"x{i} double" for i in range(columns))
    return spark.createDataFrame(rows, f"entity string, period int, {names}")


@pytest.mark.parametrize("short", [1, 2, 3, 4, 30])
def test_one_short_series_leaves_the_others_alone(spark, short):
    both = panel(spark, {"long": 80, "short": short})
    port = systems.system_portmanteau(both, ["entity"], ["x0", "x1"], 1, [10, 50]).collect()
    assert len(port) == 4 and all(r["hosking"] is not None for r in port if r["entity"] == "long")
    assert next(r for r in port if r["entity"] == "short" and r["lags"] == 50)["ljung_box"] is None
    trace = systems.johansen_trace(both, ["entity"], ["x0", "x1"], 2).collect()
    assert len(trace) == 4 and all(r["trace"] is not None for r in trace if r["entity"] == "long")
    if short < 5:
        assert all(r["trace"] is None for r in trace if r["entity"] == "short")


def test_no_lag_jumps_a_hole(spark):
    df = panel(spark, {"a": 12}, 1, hole=5)
    pdf = df.toPandas().sort_values("period")
    d = dict(zip(pdf["period"], pdf["x0"] - pdf["x0"].mean()))
    want = sum(v * d[t - 1] for t, v in d.items() if t - 1 in d) / sum(v * v for v in d.values())
    assert diagnostics.autocorrelations(df, ["entity"], "x0", 2).first()["acf"][0] == pytest.approx(want)
    marked = panel(spark, {"a": 12}, 1).withColumn("x0", F.when(F.col("period") != 105, F.col("x0")))
    assert diagnostics.autocorrelations(marked, ["entity"], "x0", 2).first()["acf"][0] == pytest.approx(want)


def test_unit_root_tests_close_holes(spark):
    df = panel(spark, {"a": 40}, 1, hole=20)
    v = df.toPandas().sort_values("period")["x0"].to_numpy()
    x = np.array([[v[t - 1], v[t - 1] - v[t - 2]] for t in range(2, len(v))])
    y = np.array([v[t] - v[t - 1] for t in range(2, len(v))])
    b, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    tau = b[0] / np.sqrt(rss[0] / (len(y) - 2) * np.linalg.inv(x.T @ x)[0, 0])
    assert diagnostics.adf_tests(df, ["entity"], "x0", 1).first()["tau1"] == pytest.approx(tau, rel=1e-6)
    # lag orders follow the longest series whatever bound is passed
    assert diagnostics.adf_trend_p(panel(spark, {"a": 200, "b": 20}, 1), ["entity"], "x0", 5).count() == 2
    assert diagnostics.kpss_tests(panel(spark, {"a": 200}, 1), ["entity"], "x0", 5).first()["level"] == pytest.approx(
        diagnostics.kpss_tests(panel(spark, {"a": 200}, 1), ["entity"], "x0").first()["level"]
    )


def test_factor_forecast_at_a_hole_is_null(spark):
    df = panel(spark, {"a": 60}, 5)
    args = (["entity"], "x0", ["x1", "x2", "x3", "x4"], 1, 2, "F", 140, 158)
    whole = {(r["training_end"], r["model_id"]): r["mean"] for r in factors.favar_backtest(df, *args).collect()}
    holed = df.withColumn("x2", F.when(F.col("period") != 150, F.col("x2")))
    got = {(r["training_end"], r["model_id"]): r["mean"] for r in factors.favar_backtest(holed, *args).collect()}
    assert got.keys() == whole.keys()
    for (end, model), mean in got.items():
        if end in (150, 151):
            assert mean is None
        elif end < 150:
            assert mean == pytest.approx(whole[end, model])
        else:
            assert mean is not None
    cv = factors.factor_cv(holed, ["entity"], "x0", ["x1", "x2", "x3", "x4"], 2).collect()
    assert len(cv) == 20


def test_null_group_stays(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 6.0)], "k string, v double")
    assert {r["k"] for r in windows.minmax_rescale(rows, ["k"], "v").collect()} == {"a", None}
    assert {(r["k"], r["v"]) for r in windows.top_with_ties(rows, ["k"], "v", 1).collect()} == {("a", 1.0), (None, 2.0)}
    got = {r["k"]: r["m"] for r in aggregates.exact_percentiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 2.0, None: 4.0}
    assert {r["k"] for r in aggregates.histogram_density(rows, ["k"], "v", 0.0, 1.0).collect()} == {"a", None}
    trials = rows.withColumnsRenamed({"v": "rmse"}).withColumn("c", F.lit(1))
    assert {r["k"] for r in ml.best_candidate(trials, ["k"], "c").collect()} == {"a", None}


def test_many_groups_same_plan(spark):
    rows = spark.range(40_000).select((F.col("id") % 20_000).alias("k"), F.col("id").cast("double").alias("v"))
    out = windows.minmax_rescale(rows, ["k"], "v")
    assert out.filter("rescaled = 1").count() == 20_000


def test_percentiles_of_small_groups_by_one_plan(spark):
    rng = np.random.default_rng(1)
    rows = [(n, float(v)) for n in [1, 2, 3, 4, 5, 7, 11, 24, 150] for v in np.round(rng.normal(size=n), 1)]
    probs = {f"p{i}": p for i, p in enumerate([0.0, 0.05, 0.1, 0.25, 1 / 3, 0.5, 0.62, 0.75, 0.9, 0.95, 1.0])}
    frame = spark.createDataFrame(rows, "n int, v double")
    for accuracy in (100_000, 100):  # the second is too coarse to be exact for the largest group
        for r in aggregates.exact_percentiles(frame, ["n"], "v", probs, accuracy).collect():
            values = [v for n, v in rows if n == r["n"]]
            for name, p in probs.items():
                assert r[name] == pytest.approx(np.quantile(values, p)), (r["n"], p)
