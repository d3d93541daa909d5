import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import arma, baselines, diagnostics as dg, evaluate, factors, ml, systems
from seriesloom.plans import bindings as b


@pytest.fixture(scope="module")
def walk(spark):
    """Two series, one with a unit root and one stationary, and two indicators."""
    rng = np.random.default_rng(11)
    rows = []
    for name, phi in (("root", 1.0), ("calm", 0.4)):
        y, x = 0.0, 0.0
        for t in range(120):
            x = 0.5 * x + rng.normal()
            y = phi * y + 0.6 * x + rng.normal()
            rows.append((name, t, y, x, rng.normal()))
    return spark.createDataFrame(rows, "entity string, period int, y double, x double, z double").cache()


def values(frame, entity, columns):
    pdf = frame.filter(F.col("entity") == entity).orderBy("period").toPandas()
    return pdf[columns].to_numpy(float)


def least_squares(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    u = y - x @ beta
    sigma2 = u @ u / (len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(sigma2 * np.linalg.inv(x.T @ x))), u


def adf_matrix(y, k):
    d = np.diff(y)
    n = len(d)
    rows = range(k, n)
    return np.array([[1.0, t + 2.0, y[t], *[d[t - i] for i in range(1, k + 1)]] for t in rows]), d[k:]


@pytest.mark.parametrize("entity", ["root", "calm"])
def test_adf_statistics(spark, walk, entity):
    y = values(walk, entity, ["y"])[:, 0]
    got = dg.adf_tests(walk, ["entity"], "y", 1).filter(F.col("entity") == entity).first()
    x, d = adf_matrix(y, 1)
    beta, se, _ = least_squares(x[:, 2:], d)
    assert got["tau1"] == pytest.approx(beta[0] / se[0], rel=1e-8)
    rss = lambda cols: float((least_squares(x[:, cols], d)[2] ** 2).sum()) if cols else float((d**2).sum())
    n = len(d)
    assert got["phi1"] == pytest.approx((rss([3]) - rss([0, 2, 3])) / 2 / (rss([0, 2, 3]) / (n - 3)), rel=1e-7)
    assert got["phi3"] == pytest.approx((rss([0, 3]) - rss([0, 1, 2, 3])) / 2 / (rss([0, 1, 2, 3]) / (n - 4)), rel=1e-7)
    trend = dg.adf_trend_p(walk, ["entity"], "y", 120).filter(F.col("entity") == entity).first()
    k = int(119 ** (1 / 3))
    x, d = adf_matrix(y, k)
    beta, se, _ = least_squares(x, d)
    assert trend["k"] == k and trend["statistic"] == pytest.approx(beta[2] / se[2], rel=1e-7)


def test_adf_order_by_bic(spark):
    rng = np.random.default_rng(4)
    series = {"short": rng.normal(size=8), "tiny": rng.normal(size=4)}
    for name, phi in {"one": [0.5], "three": [0.3, 0.0, 0.5], "many": [0.2, 0.2, 0.2, 0.3]}.items():
        d = list(rng.normal(size=4))
        for _ in range(150):
            d.append(sum(p * d[-1 - i] for i, p in enumerate(phi)) + rng.normal())
        series[name] = 1000 + np.cumsum(d)
    rows = [(name, t, float(v)) for name, y in series.items() for t, v in enumerate(y)]
    top = 4
    found = dg.adf_tests(spark.createDataFrame(rows, "entity string, period int, y double"), ["entity"], "y", max_lags=top)
    got = {r["entity"]: r for r in found.collect()}
    models = {"none": [2], "drift": [0, 2], "trend": [0, 1, 2]}
    chosen = set()
    for name in ("one", "three", "many"):
        x, d = adf_matrix(series[name], top)
        n = len(d)
        rss = lambda cols: float((least_squares(x[:, cols], d)[2] ** 2).sum())
        for model, fixed in models.items():
            order = min(range(1, top + 1), key=lambda k: n * np.log(rss([*fixed, *range(3, 3 + k)]) / n) + (len(fixed) + k) * np.log(n))
            assert got[name][f"k_{model}"] == order
            chosen.add(order)
            behind = list(range(3, 3 + order))
            full, df = rss([*fixed, *behind]), n - len(fixed) - order
            if model == "none":
                beta, se, _ = least_squares(x[:, [2, *behind]], d)
                assert got[name]["tau1"] == pytest.approx(beta[0] / se[0], rel=1e-6)
            else:
                small = rss(behind if model == "drift" else [0, *behind])
                assert got[name]["phi1" if model == "drift" else "phi3"] == pytest.approx((small - full) / 2 / (full / df), rel=1e-6)
    assert len(chosen) > 1
    # three rows have four differences behind them: one order of the model without constant, none of the others
    assert got["short"]["k_none"] in (1, 2) and got["short"]["k_trend"] is None and got["short"]["phi3"] is None
    assert got["tiny"]["k_none"] is None and got["tiny"]["tau1"] is None and got["tiny"]["size"] == 4


def test_unit_root_verdicts_differ(walk):
    p = {r["entity"]: r["p_value"] for r in dg.adf_trend_p(walk, ["entity"], "y", 120).collect()}
    assert p["root"] > 0.05 and p["calm"] <= 0.05


@pytest.mark.parametrize("entity", ["root", "calm"])
def test_kpss(walk, entity):
    y = values(walk, entity, ["y"])[:, 0]
    n = len(y)
    l = int(4 * (n / 100) ** 0.25)
    t = np.arange(1.0, n + 1)
    got = dg.kpss_tests(walk, ["entity"], "y", 120).filter(F.col("entity") == entity).first()
    for name, e in (("level", y - y.mean()), ("trend", least_squares(np.column_stack([np.ones(n), t]), y)[2])):
        s2 = (e @ e + 2 * sum((1 - j / (l + 1)) * (e[j:] @ e[:-j]) for j in range(1, l + 1))) / n
        assert got[name] == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / s2, rel=1e-9)


def test_kpss_p_is_clipped(spark):
    frame = spark.createDataFrame([(0.1,), (0.347,), (0.463,), (0.5185,), (5.0,)], "s double")
    got = [r["p"] for r in frame.select(dg.kpss_p(F.col("s"), "level").alias("p")).collect()]
    assert got == pytest.approx([0.10, 0.10, 0.05, 0.0375, 0.01])


def test_granger_pair_and_stepwise(walk):
    data = values(walk, "calm", ["y", "x", "z"])
    p = 2
    y = data[p:, 0]
    lags = lambda c: np.column_stack([data[p - k : len(data) - k, c] for k in range(1, p + 1)])
    one = np.ones((len(y), 1))
    rss = lambda *parts: float((least_squares(np.hstack([one, *parts]), y)[2] ** 2).sum())
    pair = {r["series"]: r for r in dg.granger_pairs(walk, ["entity"], "y", ["x", "z"], p).filter("entity = 'calm'").collect()}
    full, base = rss(lags(0), lags(1)), rss(lags(0))
    assert pair["x"]["f_stat"] == pytest.approx(((base - full) / p) / (full / (len(y) - 5)), rel=1e-8)
    assert pair["x"]["p_value"] < 0.01 < pair["z"]["p_value"]
    step = {r["series"]: r for r in dg.granger_stepwise(walk, ["entity"], "y", ["x", "z"], p).filter("entity = 'calm'").collect()}
    full, less = rss(lags(0), lags(1), lags(2)), rss(lags(0), lags(2))
    assert step["x"]["f_stat"] == pytest.approx(((less - full) / p) / (full / (len(y) - 7)), rel=1e-8)


def test_pacf_first_two_lags(walk):
    acf = dg.autocorrelations(walk, ["entity"], "y", 5).filter("entity = 'calm'")
    row = acf.select("acf", dg.partial_autocorrelations("acf").alias("pacf")).first()
    r1, r2 = row["acf"][0], row["acf"][1]
    assert row["pacf"][0] == pytest.approx(r1) and row["pacf"][1] == pytest.approx((r2 - r1 * r1) / (1 - r1 * r1))


def test_constant_series_gives_null_not_errors(spark):
    flat = spark.createDataFrame([("a", t, 3.0) for t in range(30)], "entity string, period int, y double")
    acf = dg.autocorrelations(flat, ["entity"], "y", 3).first()
    assert acf["acf"] == [None, None, None]
    assert dg.adf_tests(flat, ["entity"], "y", 1).first()["tau1"] is None
    assert dg.kpss_tests(flat, ["entity"], "y", 30).first()["level"] is None


def var_by_hand(data, p, steps):
    x = np.hstack([np.ones((len(data) - p, 1)), *[data[p - k : len(data) - k] for k in range(1, p + 1)]])
    y = data[p:]
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    u = y - x @ b
    sigma = u.T @ u / (len(y) - x.shape[1])
    history = [r for r in data]
    for _ in range(steps):
        history.append(b.T @ np.concatenate([[1.0], *[history[-k] for k in range(1, p + 1)]]))
    return history[len(data) :], sigma


@pytest.mark.parametrize("p", [1, 2])
def test_var_backtest_equals_refitting(walk, p):
    got = systems.var_backtest(walk, ["entity"], ["y", "x", "z"], p, "VAR", 100, 119).filter("entity = 'calm'").collect()
    data = values(walk, "calm", ["y", "x", "z"])
    assert {r["forecast_period"] for r in got if r["horizon"] == "Q"} == set(range(101, 120))
    for r in got:
        made, sigma = var_by_hand(data[: r["training_end"] + 1], p, 4)
        h = r["periods_ahead"]
        assert r["mean"] == pytest.approx(made[h - 1][0], rel=1e-7, abs=1e-9)
        assert r["error"] == pytest.approx(data[r["forecast_period"], 0] - made[h - 1][0], rel=1e-6, abs=1e-8)
        if h == 1:
            assert r["upper"] - r["mean"] == pytest.approx(1.959963984540054 * np.sqrt(sigma[0, 0]), rel=1e-7)


def test_coefficients_equal_regression(walk):
    data = values(walk, "calm", ["y", "x"])
    x = np.column_stack([np.ones(119), data[:-1, 0], data[:-1, 1]])
    beta, se, _ = least_squares(x, data[1:, 0])
    got = {r["term"]: r for r in systems.coefficient_table(walk, ["entity"], ["y", "x"], 1).filter("entity = 'calm' AND equation = 'y'").collect()}
    for i, term in enumerate(["const", "y_l1", "x_l1"]):
        assert got[term]["estimate"] == pytest.approx(beta[i], rel=1e-8) and got[term]["std_error"] == pytest.approx(se[i], rel=1e-8)


@pytest.mark.parametrize("make", ["baseline", "var", "arma", "favar"])
def test_no_forecast_sees_its_future(walk, make):
    """Changing every value after an origin changes no forecast made there."""
    origin = 108
    later = F.col("period") > origin
    bent = walk.withColumns({c: F.when(later, F.col(c) * 3 + 7).otherwise(F.col(c)) for c in ("y", "x", "z")})

    def forecasts(frame):
        if make == "baseline":
            out = baselines.baseline_records(frame, ["entity"], "y", 100, 119)
        elif make == "var":
            out = systems.var_backtest(frame, ["entity"], ["y", "x"], 2, "V", 100, 119)
        elif make == "arma":
            out = arma.arma_backtest(frame, ["entity"], "y", (2, 1), "A", 100, 119)
        else:
            out = factors.favar_backtest(frame, ["entity"], "y", ["x", "z"], 1, 3, "F", 100, 119)
        kept = out.filter(F.col("training_end") <= origin).orderBy("entity", "model_id", "training_end")
        return [(r["entity"], r["model_id"], r["training_end"], r["mean"], r["lower"]) for r in kept.collect()]

    a, c = forecasts(walk), forecasts(bent)
    assert len(a) > 10 and len(a) == len(c)
    for x, y in zip(a, c):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-9, abs=1e-9)


def test_arma_without_ma_is_least_squares(walk):
    """An AR(1) fitted by conditional sum of squares equals the regression backtest."""
    on = ["entity", "horizon", "forecast_period"]
    css = arma.arma_backtest(walk, ["entity"], "y", (1, 0), "ARIMA", 100, 119).select(*on, F.col("mean").alias("m"), F.col("upper").alias("u"))
    ols = baselines.baseline_records(walk, ["entity"], "y", 100, 119).filter("model_id LIKE 'ARIMA%'")
    both = css.join(ols, on).collect()
    assert len(both) == 2 * (19 + 19)
    for r in both:
        assert r["m"] == pytest.approx(r["mean"], rel=1e-4, abs=1e-4) and r["u"] == pytest.approx(r["upper"], rel=1e-3, abs=1e-3)


def test_arma_recovers_a_process():
    rng = np.random.default_rng(5)
    n = 4000
    e = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(2, n):
        y[t] = 0.5 * y[t - 1] - 0.3 * y[t - 2] + e[t] + 0.4 * e[t - 1]
    params, _, sse, settled = arma.fit_css((y + 2.0)[None], np.array([n]), 2, 1)
    assert params[0] == pytest.approx([2.0, 0.5, -0.3, 0.4], abs=0.08)
    assert sse[0] / n == pytest.approx(1.0, abs=0.06)


def test_arma_slices_do_not_matter():
    rng = np.random.default_rng(6)
    y = rng.normal(size=(600, 30))
    n = np.full(600, 30)
    whole = arma.fit_many(y, n, 1, 1)
    part = arma.fit_css(y[300:310], n[300:310], 1, 1)
    assert np.allclose(whole[2][300:310], part[2], rtol=1e-12) and np.allclose(whole[0][300:310], part[0], rtol=1e-9)


def test_arma_order_prefers_the_truth(spark):
    rng = np.random.default_rng(8)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    frame = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)], "entity string, period int, y double")
    best = arma.arma_orders(frame, ["entity"], "y", 3, 2).orderBy("aicc").first()
    assert best["p"] >= 1 and best["sigma2"] == pytest.approx(1.0, abs=0.2)


def test_residuals_are_orthogonal(walk):
    out = baselines.residuals_ar_one(walk, ["entity"], "y").groupBy("entity").agg(F.sum("residual").alias("s"), F.count(F.lit(1)).alias("n"))
    for r in out.collect():
        assert r["n"] == 119 and abs(r["s"]) < 1e-8


def test_components_reproduce_the_data(spark, data):
    """Scores times loadings give back the standardised data; loadings are orthonormal."""
    frame = b.vectors(spark, data)
    moments = factors.gram(frame, "v", 64)
    x = np.stack(frame.orderBy("vec_id").toPandas()["v"].to_numpy()).astype(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    w = factors.loading_rows(moments, 64, 64).toPandas().pivot(index="feature", columns="component", values="loading").to_numpy()
    assert np.allclose(w.T @ w, np.eye(64), atol=1e-9)
    s = np.stack(factors.scores(frame, "v", moments, 64, 64).orderBy("vec_id").toPandas()["scores"].to_numpy())
    assert np.allclose(s @ w.T, z, atol=1e-8)
    lam = factors.explained(moments, 64, 64).orderBy("component").toPandas()
    assert np.allclose(lam["eigenvalue"], s.var(axis=0, ddof=1), atol=1e-8) and lam["cum_pve"].iloc[-1] == pytest.approx(1.0)


def test_pcr_from_moments_equals_pcr_from_rows(spark, data):
    frame = b.vectors(spark, data).select("vec_id", (F.col("vec_id") % 5).cast("int").alias("fold"), "v")
    got = {(r["fold"], r["r"]): r["rmse"] for r in factors.pcr_cv(factors.gram(frame.select("fold", "v"), "v", 64, "fold"), 64, 4).collect()}
    pdf = frame.orderBy("vec_id").toPandas()
    x, fold = np.stack(pdf["v"].to_numpy()).astype(float), pdf["fold"].to_numpy()
    for k in range(5):
        train, test = x[fold != k], x[fold == k]
        mean, sd = train[:, :63].mean(axis=0), train[:, :63].std(axis=0, ddof=1)
        _, vectors = factors.components(np.corrcoef(train[:, :63], rowvar=False))
        for r in (1, 4):
            f = lambda part: np.column_stack([np.ones(len(part)), (part[:, :63] - mean) / sd @ vectors[:, :r]])
            beta, *_ = np.linalg.lstsq(f(train), train[:, 63], rcond=None)
            assert got[k, r] == pytest.approx(np.sqrt(((test[:, 63] - f(test) @ beta) ** 2).mean()), rel=1e-8)


def test_johansen_ignores_units(walk):
    scaled = walk.withColumn("x", F.col("x") * 1e6)
    a = systems.johansen_trace(walk, ["entity"], ["y", "x", "z"], 2).orderBy("entity", "rank").collect()
    c = systems.johansen_trace(scaled, ["entity"], ["y", "x", "z"], 2).orderBy("entity", "rank").collect()
    assert [r["trace"] for r in a] == pytest.approx([r["trace"] for r in c], rel=1e-8)
    assert a[2]["trace"] > 0 and [r["crit1"] for r in a[:3]] == [37.22, 23.52, 11.65]


def test_order_and_cointegration_from_moments(spark):
    """Against least squares on the rows themselves, with a hole, a series too short and columns far from zero."""
    rng = np.random.default_rng(21)
    long = np.cumsum(rng.normal(size=(400, 3)), axis=0) + [1e4, -50.0, 3.0]
    long[:, 1] = 0.5 * long[:, 0] + rng.normal(size=400)
    series = {"long": long, "short": rng.normal(size=(4, 3))}
    rows = [(name, t, *map(float, v)) for name, y in series.items() for t, v in enumerate(y) if (name, t) not in {("long", 100), ("long", 101)}]
    rows.append(("long", 100, 1.0, None, 2.0))
    panel = spark.createDataFrame(rows, "entity string, period int, a double, b double, c double").repartition(3)
    y = long.copy()
    y[100:102] = np.nan
    p_max = 3
    at = [t for t in range(p_max, 400) if np.isfinite(y[t - p_max : t + 1]).all()]
    n = len(at)
    got = {(r["entity"], r["p"]): r for r in systems.var_order(panel, ["entity"], ["a", "b", "c"], p_max).collect()}
    assert {name for name, _ in got} == {"long"}
    for p in range(1, p_max + 1):
        x = np.array([np.r_[1.0, y[t - p : t][::-1].ravel()] for t in at])
        u = y[at] - x @ np.linalg.lstsq(x, y[at], rcond=None)[0]
        logdet = np.linalg.slogdet(u.T @ u / n)[1]
        assert got["long", p]["aic"] == pytest.approx(logdet + 18 * p / n, rel=1e-7)
        assert got["long", p]["sc"] == pytest.approx(logdet + np.log(n) * 9 * p / n, rel=1e-7)
        assert got["long", p]["fpe"] == pytest.approx(((n + 3 * p + 1) / (n - 3 * p - 1)) ** 3 * np.exp(logdet), rel=1e-6)
    order = 2
    at = [t for t in range(order, 400) if np.isfinite(y[t - order : t + 1]).all()]
    z0, zk = np.array([y[t] - y[t - 1] for t in at]), np.array([y[t - order] for t in at])
    z1 = np.array([np.r_[1.0, y[t - 1] - y[t - 2]] for t in at])
    r0, rk = (z - z1 @ np.linalg.lstsq(z1, z, rcond=None)[0] for z in (z0, zk))
    lam = np.sort(np.linalg.eigvals(np.linalg.solve(rk.T @ rk, rk.T @ r0) @ np.linalg.solve(r0.T @ r0, r0.T @ rk)).real)[::-1]
    found = {(r["entity"], r["rank"]): r for r in systems.johansen_trace(panel, ["entity"], ["a", "b", "c"], order).collect()}
    assert len(found) == 6 and all(found["short", r]["trace"] is None for r in range(3))
    for r in range(3):
        assert found["long", r]["eigenvalue"] == pytest.approx(lam[r], rel=1e-6)
        assert found["long", r]["trace"] == pytest.approx(-len(at) * np.log1p(-lam[r:]).sum(), rel=1e-6)


def test_var_order_prefers_short_lags(walk):
    best = systems.var_order(walk, ["entity"], ["y", "x"], 6).filter("entity = 'calm'").first()
    assert best["best_sc"] == 1


def test_portmanteau_weights_are_ordered(walk):
    for r in systems.system_portmanteau(walk, ["entity"], ["y", "x"], 1, [10, 15]).collect():
        assert r["box_pierce"] < r["hosking"] < r["ljung_box"] and r["df"] == 4 * (r["lags"] - 1)
        assert 0 <= r["p_ljung_box"] <= r["p_hosking"] <= r["p_box_pierce"] <= 1


def test_causality_finds_the_driver(walk):
    got = {(r["direction"], r["series"]): r["p_value"] for r in systems.causality_tests(walk, ["entity"], ["y", "x"], 1).filter("entity = 'calm'").collect()}
    assert got["one_to_others", "x"] < 0.01 and got["others_to_one", "x"] > 0.01


def test_factor_cv_counts_folds(spark, data):
    out = factors.factor_cv(b.factor_panel(spark, data), ["entity"], "y", b.FACTOR_FEATURES, 3)
    counts = {r["r"]: r["count"] for r in out.filter("entity = 'A'").groupBy("r").count().collect()}
    assert counts == {1: 10, 2: 10, 3: 10}


def test_test_folds_keep_the_gap():
    made = ml.test_folds(100, 104, 3, skip=2, width=10)
    assert [(f.test, f.train_to, f.train_from) for f in made] == [(100, 96, 87), (102, 98, 89), (104, 100, 91)]


def test_kernel_regression_learns_a_curve(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(40):
        for e in range(20):
            x = rng.uniform(-2, 2, size=2)
            rows.append((str(e), t, float(np.sin(x[0]) + 0.5 * x[1] + 0.05 * rng.normal()), [float(v) for v in x]))
    frame = spark.createDataFrame(rows, "entity string, period int, y double, x array<double>")
    folds = ml.test_folds(38, 39, 0)
    models = [ml.SvrModel(i, kernel, 10.0, 0.05, f) for i, (kernel, f) in enumerate((k, f) for k in ("radial", "sigmoid") for f in folds)]
    out = ml.fold_scores(ml.KernelRegression(frame, ["entity"], models, 24).predictions(), ["model"])
    scores = {r["model"]: r["rmse"] for r in out.collect()}
    assert len(scores) == 4 and max(scores[0], scores[1]) < 0.25 and max(scores[2], scores[3]) < 0.4


@pytest.mark.parametrize("kernel", ["radial", "sigmoid", "polynomial"])
def test_kernel_regression_reaches_the_optimum(spark, kernel):
    """No slow subgradient descent on the exact objective gets below the fitted one."""
    rng = np.random.default_rng(3)
    rows = [(t % 5, t // 5, float(np.tanh(x[0]) + 0.1 * rng.normal()), x.tolist()) for t, x in enumerate(rng.normal(size=(200, 2)))]
    frame = spark.createDataFrame(rows, "entity int, period int, y double, x array<double>")
    model = ml.SvrModel(0, kernel, 0.3, 0.1, ml.Fold(1, 100, 100))
    fit = ml.KernelRegression(frame, ["entity"], [model])
    x, y = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    phi, t = fit.space.features(x, model), (y - fit.space.y_mean) / fit.space.y_sd
    ridge = np.ones(phi.shape[1])
    ridge[-1] = 1e-9

    def objective(w):
        return 0.5 * w @ (ridge * w) + model.cost * np.maximum(np.abs(t - phi @ w) - model.epsilon, 0).sum()

    w, best = np.zeros(phi.shape[1]), np.inf
    for k in range(20_000):
        r = t - phi @ w
        w = w - (0.2 / (10 + k)) * (ridge * w - model.cost * phi.T @ (np.sign(r) * (np.abs(r) > model.epsilon)))
        best = min(best, objective(w))
    assert objective(fit.weights[0]) <= best + 2e-3 * best
    with pytest.raises(RuntimeError):
        ml.KernelRegression(frame, ["entity"], [model], rounds=1)


def test_vectors_of_another_length_raise(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 0.0, 2.0],)], "v array<double>")
    with pytest.raises(ValueError):
        factors.gram(frame, "v", 2)


def test_arma_does_not_close_holes():
    """With a hole the AR(1) fit uses only true neighbours."""
    rng = np.random.default_rng(4)
    y = np.zeros(60)
    for t in range(1, 60):
        y[t] = 0.6 * y[t - 1] + rng.normal()
    y[[20, 21, 40]] = np.nan
    params, _, _, _ = arma.fit_css(y[None], np.array([60]), 1, 0)
    a, c = y[:-1], y[1:]
    good = np.isfinite(a) & np.isfinite(c)
    slope = np.polyfit(a[good], c[good], 1)[0]
    assert params[0, 1] == pytest.approx(slope, abs=1e-5)


def test_all_comparisons_agree_with_pairwise_tests(spark):
    rng = np.random.default_rng(9)
    rows = []
    for e in range(3):
        for h, horizon in ((1, "Q"), (4, "Y")):
            for t in range(100, 130):
                if e == 2 and t in (110, 111):
                    continue
                rows += [(f"e{e}", f"{m}_{horizon}{'_I2' if m == 'RF' else ''}", horizon, h, t, None if (e, m, t) == (1, "B", 105) else float(rng.normal() * s)) for m, s in (("A", 1.0), ("B", 1.4), ("RF", 0.8))]
    frame = spark.createDataFrame(rows, "entity string, model_id string, horizon string, periods_ahead int, forecast_period int, error double")
    got = {(r["entity"], r["horizon"], r["model"], r["benchmark"]): r for r in evaluate.all_comparisons(frame, ["entity"], ["A", "B", "RF"]).collect()}
    assert len(got) == 3 * 2 * 6
    for (entity, horizon, m, b), r in got.items():
        h = r["periods_ahead"]
        error = {k: {t: x for e, i, z, _, t, x in rows if (e, z) == (entity, horizon) and i.startswith(k + "_") and x is not None} for k in ("A", "B", "RF")}
        at = sorted(set.intersection(*(set(v) for v in error.values())))
        d = {t: error[b][t] ** 2 - error[m][t] ** 2 for t in at}
        mean = np.mean(list(d.values()))
        cov = [sum((d[t] - mean) * (d[t - k] - mean) for t in at if t - k in d) for k in range(h)]
        n = len(at)
        v = (cov[0] + 2 * sum(cov[1:])) / n**2
        assert r["n"] == n and r["mean_d"] == pytest.approx(mean)
        assert r["statistic"] == (pytest.approx(mean / np.sqrt(v) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)) if v > 0 else None)
    plain = frame.withColumn("model_id", F.regexp_replace("model_id", "_I2$", "")).filter("entity = 'e0'")
    for r in evaluate.dm_statistic(plain, ["entity"], [("A", "B"), ("RF", "A")]).collect():
        assert got["e0", r["horizon"], r["model"], r["benchmark"]]["statistic"] == pytest.approx(r["statistic"])


def refitted(values, features, r, p, steps):
    """Scores and a system fitted on the raw rows of one origin."""
    whole = np.isfinite(features).all(axis=1)
    seen = features[whole]
    keep = seen.std(axis=0, ddof=1) > 0
    z = (seen[:, keep] - seen[:, keep].mean(axis=0)) / seen[:, keep].std(axis=0, ddof=1)
    scores = np.full((len(features), min(r, z.shape[1])), np.nan)
    scores[whole] = z @ factors.components(np.atleast_2d(np.corrcoef(z, rowvar=False)))[1][:, :r]
    data = np.column_stack([values, scores])
    x, y = systems.design(data, p)
    if len(x) <= x.shape[1] or not np.isfinite(data[-p:]).all():
        return None
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    u = y - x @ coef
    state = data[-1 : -p - 1 : -1].reshape(1, -1)
    mean, se = systems.companion_forecast(coef[None], (u.T @ u / (len(x) - x.shape[1]))[None], state, p, steps)
    return mean[0, :, 0], se[0, :, 0]


@pytest.mark.parametrize("trial", range(6))
def test_growing_moments_equal_refits(trial):
    rng = np.random.default_rng(trial)
    k, p, t = int(rng.integers(2, 8)), int(rng.integers(1, 4)), 80
    d = rng.normal(size=(t, k + 1))
    d[:, 1:] += rng.normal(size=(t, 1)).cumsum(0) * 0.3
    d = d * 10.0 ** rng.integers(-3, 6, k + 1)
    d += 5 * d.std(0) * rng.normal(size=k + 1)
    if trial % 2:
        d[rng.integers(0, 70, 2), rng.integers(0, k + 1, 2)] = np.nan
    if trial == 4:
        d[:, 2] = 7.0
    sample = factors.ExpandingFactors(d, p)
    for rows in range(40, t):
        sample.advance(rows)
        for r in (1, 2):
            want, got = refitted(d[:rows, 0], d[:rows, 1:], r, p, 4), sample.forecast(sample.loadings(r), 4)
            assert (want is None) == (got is None)
            if want is not None:
                assert got[0] == pytest.approx(want[0], rel=1e-8, abs=1e-8 * np.nanmax(np.abs(d[:rows, 0])))
                assert got[1] == pytest.approx(want[1], rel=1e-8)
