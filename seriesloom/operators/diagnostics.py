"""Diagnostics of many series at once: autocorrelation, unit roots, stationarity, causality."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from seriesloom.functions.scalars import chi2_tail_even, critical_bucket, normal_quantile, ratio
from seriesloom.functions.tails import f_tail
from seriesloom.operators.moments import ONE, f_statistic, grouped_moments, map_rows, nested_rss, ols, shift_to_start, unpack
from seriesloom.operators.reshape import by_period, recode, row_sum
from seriesloom.operators.windows import at_lag, lagged

# --- autocorrelation -----------------------------------------------------------------------


def autocorrelations(panel: DataFrame, keys: list[str], value: str, lags: int = 10) -> DataFrame:
    """``n`` and the array ``acf`` of lags 1.. per series (full-sample mean and denominator)."""
    seen = panel.filter(F.col(value).isNotNull())
    centred = seen.withColumn("_d", F.col(value) - F.avg(value).over(W.partitionBy(*keys)))
    products = {f"_p{k}": F.col("_d") * at_lag("_d", keys, k) for k in range(1, lags + 1)}
    sums = centred.withColumns(products).groupBy(*keys).agg(
        F.count("_d").alias("n"),
        F.sum(F.col("_d") * F.col("_d")).alias("_s0"),
        *[F.sum(c).alias(c) for c in products],
    )
    return sums.select(*keys, "n", F.array(*[ratio(F.col(c), F.col("_s0")) for c in products]).alias("acf"))


def acf_rows(acf: DataFrame, keys: list[str], level: float = 95.0) -> DataFrame:
    """One row per lag with the white-noise band."""
    z = normal_quantile(level)
    rows = acf.select(*keys, "n", F.posexplode("acf").alias("_i", "acf"))
    return rows.select(*keys, (F.col("_i") + 1).cast("int").alias("lag"), "n", "acf", (F.lit(z) / F.sqrt("n")).alias("band"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def partial_autocorrelations(acf: pd.Series) -> pd.Series:
    """Durbin-Levinson recursion, run lag by lag for all series of a batch at once."""
    r = np.array([np.asarray(a, dtype=float) for a in acf])
    count, lags = r.shape
    phi = np.zeros((count, lags, lags))
    out = np.empty_like(r)
    with np.errstate(all="ignore"):
        for k in range(lags):
            head = phi[:, k - 1, :k] if k else np.zeros((count, 0))
            top = r[:, k] - np.einsum("bi,bi->b", head, r[:, :k][:, ::-1])
            last = top / (1.0 - np.einsum("bi,bi->b", head, r[:, :k]))
            phi[:, k, k] = last
            phi[:, k, :k] = head - last[:, None] * head[:, ::-1]
            out[:, k] = last
    return pd.Series(list(np.where(np.isfinite(out), out, np.nan)))


def portmanteau(acf: DataFrame, keys: list[str], lags: int = 10) -> DataFrame:
    """Ljung-Box and Box-Pierce statistics; p-values in closed form for an even number of lags."""
    n = F.col("n")
    squares = [F.pow(F.col("acf")[k - 1], F.lit(2.0)) for k in range(1, lags + 1)]
    lb = n * (n + 2) * reduce(lambda a, b: a + b, [ratio(s, n - k) for k, s in enumerate(squares, 1)])
    bp = n * reduce(lambda a, b: a + b, squares)
    stats = acf.select(*keys, "n", lb.alias("ljung_box"), bp.alias("box_pierce"))
    return stats.withColumn("p_ljung_box", chi2_tail_even(F.col("ljung_box"), lags)).withColumn(
        "p_box_pierce", chi2_tail_even(F.col("box_pierce"), lags)
    )


# --- unit roots ----------------------------------------------------------------------------

# Published critical values by sample size 25, 50, 100, 250, 500 and beyond
# (Fuller 1976; Dickey and Fuller 1981), in the order 1 %, 5 %, 10 %.
ADF_CRITICAL = {
    "tau1": [
        (-2.66, -1.95, -1.60), (-2.62, -1.95, -1.61), (-2.60, -1.95, -1.61),
        (-2.58, -1.95, -1.62), (-2.58, -1.95, -1.62), (-2.58, -1.95, -1.62),
    ],
    "phi1": [
        (7.88, 5.18, 4.12), (7.06, 4.86, 3.94), (6.70, 4.71, 3.86), (6.52, 4.63, 3.81), (6.47, 4.61, 3.79), (6.43, 4.59, 3.78),
    ],
    "phi3": [
        (10.61, 7.24, 5.91), (9.31, 6.73, 5.61), (8.73, 6.49, 5.47), (8.43, 6.34, 5.39), (8.34, 6.30, 5.36), (8.27, 6.25, 5.34),
    ],
}
ADF_SIZES = (25, 50, 100, 250, 500)
# Published quantiles of the trend statistic (Banerjee et al. 1993) by sample size.
ADF_P_SIZES = [25, 50, 100, 250, 500, 100_000]
ADF_P_LEVELS = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
ADF_P_TABLE = [
    [-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15],
    [-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24],
    [-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28],
    [-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31],
    [-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32],
    [-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33],
]


def adf_critical(name: str, n: Column, which: int) -> Column:
    """Critical value for the number of differences: the row of the next larger tabulated size."""
    table = ADF_CRITICAL[name]
    out: Column = F.lit(float(table[-1][which]))
    for size, row in reversed(list(zip(ADF_SIZES, table))):
        out = F.when(n < size, F.lit(float(row[which]))).otherwise(out)
    return out


def _unit_root_frame(panel: DataFrame, keys: list[str], value: str, lags: int) -> tuple[DataFrame, list[str]]:
    """Regressors of the tests. Missing values are dropped first, so these tests close the holes of a series."""
    seen = panel.filter(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double"))
    seen = seen.withColumn("period", F.row_number().over(W.partitionBy(*keys).orderBy("period")))
    seen = shift_to_start(seen, keys, ["_x"])
    whole = W.partitionBy(*keys)
    base = seen.withColumns(
        {
            "_t": F.col("period").cast("double"),
            "_size": F.count(F.lit(1)).over(whole),
            "_y1": at_lag("_x", keys),
        }
    ).withColumn("_dy", F.col("_x") - F.col("_y1"))
    names = [f"_d{k}" for k in range(1, lags + 1)]
    found = base.withColumns({c: at_lag("_dy", keys, k) for k, c in enumerate(names, 1)})
    # how many lagged differences in a row a period has behind it
    depth = F.when(F.col("_dy").isNull(), -1)
    for k, c in enumerate(names):
        depth = depth.when(F.col(c).isNull(), k)
    return found.withColumn("_depth", depth.otherwise(lags)).fillna(0.0, names), names


def _least_bic(m: np.ndarray, fixed: list[int], lags: list[int], dy: int, least: int) -> np.ndarray:
    """Lag order from ``least`` on of least BIC on the same rows, the lower one of equals; 0 where no order leaves a degree of freedom."""
    n = m[:, 0, 0]
    rss = nested_rss(m, [*fixed, *lags], dy)[:, len(fixed) + least - 1 :]
    size = len(fixed) + np.arange(least, len(lags) + 1)
    with np.errstate(all="ignore"):
        bic = n[:, None] * np.log(rss / n[:, None]) + size * np.log(n)[:, None]
    bic = np.where(n[:, None] > size, bic, np.inf)
    return np.where(np.isinf(bic).all(1) & ~(bic == -np.inf).any(1), 0, least + bic.argmin(1))


def adf_tests(panel: DataFrame, keys: list[str], value: str, lag: int = 1, max_lags: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller statistics without constant (tau1), with drift (phi1), with trend (phi3).

    ``lag`` lagged differences enter; with ``max_lags``, each of the three models takes the order from 1 to
    ``max_lags`` of least BIC, all orders on the rows that have ``max_lags`` differences behind them, and
    ``k_none``, ``k_drift`` and ``k_trend`` tell it. A series too short for any order has NULL there.
    """
    top = max_lags or lag
    frame, lags = _unit_root_frame(panel, keys, value, top)
    columns = [ONE, "_t", "_y1", *lags, "_dy"]
    sums = grouped_moments(frame, keys, columns, F.col("_depth") >= top, F.max("_size").alias("size"), F.max("_s__x").alias("shift"))
    dy, d = len(columns) - 1, list(range(3, 3 + top))
    fixed = {"none": [2], "drift": [0, 2], "trend": [0, 1, 2]}
    orders = [f"k_{model}" for model in fixed] if max_lags else []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["moments"], len(columns))
        # without a constant the level itself is the regressor: undo its shift
        level = np.broadcast_to(np.eye(len(columns)), m.shape).copy()
        level[:, 2, 0] = pdf["shift"]
        moments = {"none": level @ m @ np.transpose(level, (0, 2, 1)), "drift": m, "trend": m}
        out = pdf[[*keys, "size"]].copy()
        stats = {c: np.full(len(pdf), np.nan) for c in ("tau1", "phi1", "phi3", "tau3")}
        for model, x in fixed.items():
            order = _least_bic(moments[model], x, d, dy, 1) if max_lags else np.full(len(pdf), lag)
            if max_lags:
                out[f"k_{model}"] = pd.Series(order, index=out.index, dtype="Int32").mask(order == 0)
            for k in np.unique(order[order > 0] if max_lags else order):
                mine = order == k
                at, behind = moments[model][mine], d[: int(k)]
                fit = ols(at, [*x, *behind], dy)
                with np.errstate(all="ignore"):
                    if model == "none":
                        stats["tau1"][mine] = fit["beta"][:, 0] / fit["se"][:, 0]
                    elif model == "drift":
                        stats["phi1"][mine] = f_statistic(ols(at, behind, dy), fit, 2)
                    else:
                        stats["phi3"][mine] = f_statistic(ols(at, [0, *behind], dy), fit, 2)
                        stats["tau3"][mine] = fit["beta"][:, 2] / fit["se"][:, 2]
        return out.assign(**stats)[[*keys, "size", *stats, *orders]]

    schema = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    found = ", ".join(["tau1 double, phi1 double, phi3 double, tau3 double", *[f"{c} int" for c in orders]])
    stats = map_rows(sums, run, f"{schema}, size bigint, {found}")
    n = F.col("size") - 1
    clean = stats.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("tau1", "phi1", "phi3", "tau3")})

    def bucket(name: str, lower: bool) -> Column:
        return critical_bucket(F.col(name), *[adf_critical(name, n, i) for i in range(3)], lower_tail=lower)

    return clean.withColumns({"p_none": bucket("tau1", True), "p_drift": bucket("phi1", False), "p_trend": bucket("phi3", False)})


def longest_series(panel: DataFrame, keys: list[str], value: str) -> int:
    """Observations of the longest series: one number, which bounds lag orders."""
    return panel.filter(F.col(value).isNotNull()).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def adf_trend_p(panel: DataFrame, keys: list[str], value: str, max_periods: int | None = None) -> DataFrame:
    """Trend statistic with ``trunc((n - 1)^(1/3))`` lags per series and its interpolated p-value."""
    max_periods = max(2, max_periods or 0, longest_series(panel, keys, value))
    top = max(1, int((max_periods - 1) ** (1 / 3) + 1e-9))
    frame, lags = _unit_root_frame(panel, keys, value, top)
    order = F.floor(F.pow(F.col("_size") - 1.0, F.lit(1.0 / 3.0)) + 1e-9)
    frame = frame.withColumn("_k", order.cast("int"))
    columns = [ONE, "_t", "_y1", *lags, "_dy"]
    sums = grouped_moments(frame, keys, columns, F.col("_depth") >= F.col("_k"), F.max("_size").alias("size"), F.max("_k").alias("k"))
    dy = len(columns) - 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["moments"], len(columns))
        stat = np.full(len(pdf), np.nan)
        for k in pdf["k"].unique():
            mine = (pdf["k"] == k).to_numpy()
            fit = ols(m[mine], [0, 1, 2, *range(3, 3 + int(k))], dy)
            with np.errstate(all="ignore"):
                stat[mine] = fit["beta"][:, 2] / fit["se"][:, 2]
        table = np.array(ADF_P_TABLE)
        p = [
            np.interp(s, [np.interp(n, ADF_P_SIZES, table[:, j]) for j in range(table.shape[1])], ADF_P_LEVELS) if s == s else np.nan
            for s, n in zip(stat, pdf["size"] - 1)
        ]
        return pdf[[*keys, "k"]].assign(statistic=stat, p_value=p)

    schema = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys)
    out = map_rows(sums, run, f"{schema}, k int, statistic double, p_value double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("statistic", "p_value")})


# Published critical values at 10, 5, 2.5 and 1 % (Kwiatkowski et al. 1992).
KPSS_LEVELS = [0.10, 0.05, 0.025, 0.01]
KPSS_CRITICAL = {"level": [0.347, 0.463, 0.574, 0.739], "trend": [0.119, 0.146, 0.176, 0.216]}


def kpss_p(statistic: Column, kind: str) -> Column:
    """Linear between tabulated values, clipped to [0.01, 0.1]."""
    crit = KPSS_CRITICAL[kind]
    out: Column = F.lit(KPSS_LEVELS[-1])
    for (a, b), (p, q) in reversed(list(zip(zip(crit, crit[1:]), zip(KPSS_LEVELS, KPSS_LEVELS[1:])))):
        out = F.when(statistic < b, F.lit(p) + (statistic - a) / (b - a) * (q - p)).otherwise(out)
    out = F.when(statistic <= crit[0], F.lit(KPSS_LEVELS[0])).otherwise(out)
    return F.when(statistic.isNotNull(), out)


def kpss_tests(panel: DataFrame, keys: list[str], value: str, max_periods: int | None = None) -> DataFrame:
    """KPSS statistics around a level and a trend, short Bartlett window.

    The lag length depends on each series' size, so weights beyond it are zero; the longest series
    bounds the number of lag products. All windows share one partitioning and order.
    """
    max_periods = max(2, max_periods or 0, longest_series(panel, keys, value))
    top = int(4 * (max_periods / 100) ** 0.25 + 1e-9)
    w, whole = by_period(keys), W.partitionBy(*keys)
    seen = panel.filter(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double"))
    begin = F.min("period").over(whole)
    timed = seen.withColumn("_t", (F.col("period") - begin + 1).cast("double")).withColumn("_n", F.count("_x").over(whole))
    x, t = F.col("_x"), F.col("_t")
    fits = timed.withColumn("_el", x - F.avg(x).over(whole)).withColumn(
        "_et", x - (F.regr_intercept(x, t).over(whole) + F.regr_slope(x, t).over(whole) * t)
    )
    size = F.floor(4.0 * F.pow(F.col("_n") / 100.0, F.lit(0.25)) + 1e-9)
    parts = fits.withColumn("_l", size)
    columns: dict[str, Column] = {}
    for e in ("_el", "_et"):
        columns[f"{e}_s"] = F.sum(e).over(w.rowsBetween(W.unboundedPreceding, 0))
        for k in range(1, top + 1):
            weight = F.greatest(F.lit(0.0), 1.0 - F.lit(float(k)) / (F.col("_l") + 1.0))
            columns[f"{e}_{k}"] = weight * F.col(e) * F.coalesce(at_lag(e, keys, k), F.lit(0.0))
    parts = parts.withColumns(columns)

    def statistic(e: str) -> Column:
        s, n = F.col(f"{e}_s"), F.max("_n")
        long_run = F.sum(F.col(e) * F.col(e)) / n
        for k in range(1, top + 1):
            long_run = long_run + 2.0 * F.sum(f"{e}_{k}") / n
        return ratio(F.sum(s * s), n * n * long_run)

    out = parts.groupBy(*keys).agg(F.max("_n").alias("n"), statistic("_el").alias("level"), statistic("_et").alias("trend"))
    return out.withColumn("p_level", kpss_p(F.col("level"), "level")).withColumn("p_trend", kpss_p(F.col("trend"), "trend"))


VERDICTS = ["adf_none", "adf_drift", "adf_trend1", "adf_trend2", "kpss_level", "kpss_trend"]
TREND_VERDICTS = ["adf_trend1", "adf_trend2", "kpss_trend"]
LEVEL_VERDICTS = ["adf_none", "adf_drift", "kpss_level"]


def verdicts(adf: DataFrame, adf_p: DataFrame, kpss: DataFrame, keys: list[str]) -> DataFrame:
    """Six text verdicts per series; all three inputs have one row per series."""

    def text(nonstationary: Column) -> Column:
        return F.when(nonstationary, F.lit("non-stationary")).when(~nonstationary, F.lit("stationary"))

    weak = ["<0.1", ">0.1"]
    joined = (
        adf.join(adf_p.select(*keys, F.col("p_value").alias("_adf_p")), keys)
        .join(kpss.select(*keys, F.col("p_level").alias("_pl"), F.col("p_trend").alias("_pt")), keys)
    )
    return joined.select(
        *keys,
        text(F.col("p_none").isin(weak)).alias("adf_none"),
        text(F.col("p_drift").isin(weak)).alias("adf_drift"),
        text(F.col("p_trend").isin(weak)).alias("adf_trend1"),
        text(F.col("_adf_p") > 0.05).alias("adf_trend2"),
        text(F.col("_pl") < 0.05).alias("kpss_level"),
        text(F.col("_pt") < 0.05).alias("kpss_trend"),
    )


def stationarity_vote(votes: DataFrame) -> DataFrame:
    coded = recode(votes, VERDICTS, {"stationary": 0, "non-stationary": 1})
    return coded.withColumns(
        {"total": row_sum(VERDICTS), "total_trend": row_sum(TREND_VERDICTS), "total_level": row_sum(LEVEL_VERDICTS)}
    )


# --- causality -----------------------------------------------------------------------------


def granger_pairs(panel: DataFrame, keys: list[str], target: str, features: list[str], lags: int = 1) -> DataFrame:
    """F-test per series and feature: do lags of the feature help an autoregression of the target."""
    w = by_period(keys)
    panel = shift_to_start(panel, keys, [target, *features])
    frame = panel.withColumns({f"_y{k}": lagged(target, keys, k) for k in range(1, lags + 1)})
    frame = frame.withColumns({f"_{c}_{k}": F.lag(c, k).over(w) for c in features for k in range(1, lags + 1)})
    cells = [
        F.struct(F.lit(c).alias("series"), *[F.col(f"_{c}_{k}").cast("double").alias(f"_x{k}") for k in range(1, lags + 1)])
        for c in features
    ]
    ys = [f"_y{k}" for k in range(1, lags + 1)]
    long = frame.select(*keys, F.col(target).alias("_y"), *ys, F.explode(F.array(*cells)).alias("_f")).select(*keys, "_y", *ys, "_f.*")
    columns = [ONE, *ys, *[f"_x{k}" for k in range(1, lags + 1)], "_y"]
    sums = grouped_moments(long, [*keys, "series"], columns)
    y, base, full = len(columns) - 1, list(range(0, lags + 1)), list(range(0, 2 * lags + 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["moments"], len(columns))
        large = ols(m, full, y)
        f = f_statistic(ols(m, base, y), large, lags)
        p = f_tail(np.nan_to_num(f), np.full(len(f), float(lags)), np.maximum(large["df"], 1.0))
        return pdf[[*keys, "series"]].assign(n=large["n"], f_stat=f, p_value=np.where(np.isnan(f), np.nan, p))

    schema = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(sums, run, f"{schema}, series string, n double, f_stat double, p_value double")


def granger_stepwise(panel: DataFrame, keys: list[str], target: str, features: list[str], lags: int = 1) -> DataFrame:
    """F-test per feature: does dropping its lags hurt the regression on the lags of everything.

    One moment matrix per series serves the full and all reduced models.
    """
    columns_in = [target, *features]
    panel = shift_to_start(panel, keys, columns_in)
    frame = panel.withColumns({f"_{c}_{k}": lagged(c, keys, k) for c in columns_in for k in range(1, lags + 1)})
    columns = [ONE, *[f"_{c}_{k}" for c in columns_in for k in range(1, lags + 1)], target]
    sums = grouped_moments(frame, keys, columns)
    y, everything = len(columns) - 1, list(range(len(columns) - 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["moments"], len(columns))
        full = ols(m, everything, y)
        out = []
        for i, c in enumerate(features):
            gone = set(range(1 + lags * (i + 1), 1 + lags * (i + 2)))
            f = f_statistic(ols(m, [j for j in everything if j not in gone], y), full, lags)
            p = f_tail(np.nan_to_num(f), np.full(len(f), float(lags)), np.maximum(full["df"], 1.0))
            out.append(pdf[keys].assign(series=c, n=full["n"], f_stat=f, p_value=np.where(np.isnan(f), np.nan, p)))
        return pd.concat(out)

    schema = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(sums, run, f"{schema}, series string, n double, f_stat double, p_value double")
