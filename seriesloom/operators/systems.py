"""Vector autoregressions: backtests on expanding moments, coefficient tables, system diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.scalars import band
from seriesloom.functions.tails import f_tail, gamma_tail, t_tail
from seriesloom.operators.baselines import HORIZON_NAMES, RECORD_COLUMNS
from seriesloom.operators.moments import (
    ONE, grouped_moments, lag_columns, lag_moments, map_rows, moment_array, ols, per_series, shift_to_start, solve, sweep_out, unpack,
)
from seriesloom.operators.reshape import by_period
from seriesloom.operators.windows import expanding


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def to_records(forecasts: DataFrame, keys: list[str], model: str, level: float = 95.0) -> DataFrame:
    """Rows ``training_end, periods_ahead, true_value, mean, se`` as forecast records."""
    name = F.lit("H")
    for h, label in HORIZON_NAMES.items():
        name = F.when(F.col("periods_ahead") == h, F.lit(label)).otherwise(name)
    clean = forecasts.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("true_value", "mean", "se")})
    lower, upper = band(F.col("mean"), F.col("se"), level)
    return clean.withColumns(
        {
            "horizon": name,
            "model_id": F.concat(F.lit(model + "_"), name),
            "forecast_period": (F.col("training_end") + F.col("periods_ahead")).cast("int"),
            "lower": lower,
            "upper": upper,
            "error": F.col("true_value") - F.col("mean"),
            "strategy": F.lit("iterated"),
            "band_kind": F.lit(f"{level:g}%"),
        }
    ).select(*keys, *RECORD_COLUMNS)


FORECAST_FIELDS = "training_end int, periods_ahead int, true_value double, mean double, se double"


def companion_forecast(coef: np.ndarray, sigma: np.ndarray, state: np.ndarray, p: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Iterated forecasts and their standard errors of all variables, for a stack of systems.

    ``coef`` is (B, 1 + K p, K) with the constant first and lag blocks in order; ``state`` holds
    the latest p observations, newest first, as (B, K p).
    """
    count, k = coef.shape[0], coef.shape[2]
    a = np.zeros((count, k * p, k * p))
    a[:, :k, :] = np.transpose(coef[:, 1:, :], (0, 2, 1))
    if p > 1:
        a[:, k:, :-k] = np.eye(k * (p - 1))
    const = np.zeros((count, k * p))
    const[:, :k] = coef[:, 0, :]
    power = np.broadcast_to(np.eye(k * p), a.shape).copy()
    mse = np.zeros((count, k, k))
    means, errors = [], []
    x = state
    for _ in range(steps):
        x = const + np.einsum("bij,bj->bi", a, x)
        psi = power[:, :k, :k]
        mse = mse + psi @ sigma @ np.transpose(psi, (0, 2, 1))
        power = power @ a
        means.append(x[:, :k])
        with np.errstate(all="ignore"):
            errors.append(np.sqrt(np.einsum("bii->bi", mse)))
    return np.stack(means, 1), np.stack(errors, 1)


def var_from_moments(m: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual covariance (degrees of freedom corrected) and sample size."""
    z = 1 + k * p
    xx, xy, yy = m[:, :z, :z], m[:, :z, z:], m[:, z:, z:]
    coef, _ = solve(xx, xy)
    n = m[:, 0, 0]
    with np.errstate(all="ignore"):
        rss = yy - np.transpose(coef, (0, 2, 1)) @ xy
        sigma = rss / np.where(n - z > 0, n - z, np.nan)[:, None, None]
    return coef, sigma, n


def var_backtest(
    panel: DataFrame, keys: list[str], columns: list[str], p: int, model: str, cut: int, last: int, horizons: tuple[int, ...] = (1, 4)
) -> DataFrame:
    """VAR(p) with constant at every origin; the first column is the target.

    Moments of (1, lags, values) accumulate over the series in one window pass. Each origin then
    is one row holding its moments and latest values; the solves need no shuffle and no raw data.
    """
    k = len(columns)
    frame, lags = lag_columns(shift_to_start(panel, keys, columns), keys, columns, p)
    names = [ONE, *lags, *columns]
    latest = [F.col(c).cast("double") for c in (*columns, *lags[: k * (p - 1)])]
    w = by_period(keys)
    rows = frame.select(
        *keys,
        "period",
        moment_array(names, expanding(keys)).alias("moments"),
        F.array(*latest).alias("state"),
        F.array(*[F.lead(columns[0], h).over(w).cast("double") for h in horizons]).alias("truth"),
        F.col(f"_s_{columns[0]}").alias("shift"),
    ).filter(F.col("period").between(cut + 1 - max(horizons), last - min(horizons)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["moments"], len(names))
        coef, sigma, _ = var_from_moments(m, k, p)
        state = np.array([np.asarray(s, dtype=float) for s in pdf["state"]])
        truth = np.array([np.asarray(t, dtype=float) for t in pdf["truth"]])
        mean, se = companion_forecast(coef, sigma, state, p, max(horizons))
        shift = pdf["shift"].to_numpy(float)
        truth, mean = truth + shift[:, None], mean + shift[:, None, None]
        parts = [
            pdf[keys].assign(
                training_end=pdf["period"], periods_ahead=h, true_value=truth[:, i], mean=mean[:, h - 1, 0], se=se[:, h - 1, 0]
            )
            for i, h in enumerate(horizons)
        ]
        return pd.concat(parts)

    out = map_rows(rows, run, f"{key_schema(rows, keys)}, {FORECAST_FIELDS}")
    target = F.col("training_end") + F.col("periods_ahead")
    return to_records(out.filter(target.between(cut + 1, last)), keys, model)


def coefficient_table(panel: DataFrame, keys: list[str], columns: list[str], p: int) -> DataFrame:
    """Estimate, standard error, t, p and fit statistics per series, equation and term."""
    frame, lags = lag_columns(shift_to_start(panel, keys, columns), keys, columns, p)
    names = [ONE, *lags, *columns]
    terms = ["const", *lags]
    sums = grouped_moments(frame, keys, names, None, F.array(*[F.max(f"_s_{c}") for c in columns]).alias("shift"))
    x = list(range(len(terms)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["moments"], len(names))
        shift = np.array([np.asarray(v, dtype=float) for v in pdf["shift"]])
        # the constant in original units is a combination of the shifted coefficients
        back = np.hstack([np.ones((len(pdf), 1)), -np.tile(shift, (1, p))])
        parts = []
        for e, name in enumerate(columns):
            y = len(terms) + e
            fit = ols(m, x, y)
            fit["se"][:, 0] = np.sqrt(fit["sigma2"] * np.einsum("bi,bij,bj->b", back, fit["inverse"], back))
            fit["beta"][:, 0] = np.einsum("bi,bi->b", back, fit["beta"]) + shift[:, e]
            with np.errstate(all="ignore"):
                tss = m[:, y, y] - m[:, 0, y] ** 2 / m[:, 0, 0]
                r2 = 1 - fit["rss"] / tss
                adj = 1 - (1 - r2) * (fit["n"] - 1) / fit["df"]
                f = (r2 / (len(x) - 1)) / ((1 - r2) / fit["df"])
                t = fit["beta"] / fit["se"]
            df = np.maximum(fit["df"], 1.0)
            for i, term in enumerate(terms):
                p_value = 2 * t_tail(np.abs(np.nan_to_num(t[:, i])), df)
                parts.append(
                    pdf[keys].assign(
                        equation=name, term=term, estimate=fit["beta"][:, i], std_error=fit["se"][:, i], t_value=t[:, i],
                        p_value=np.where(np.isnan(t[:, i]), np.nan, p_value), r2=r2, adj_r2=adj, f_stat=f, n=fit["n"],
                    )
                )
        return pd.concat(parts)

    fields = "estimate double, std_error double, t_value double, p_value double, r2 double, adj_r2 double, f_stat double, n double"
    return map_rows(sums, run, f"{key_schema(sums, keys)}, equation string, term string, {fields}")


# --- system diagnostics: one small least-squares problem per series ------------------------


def on_calendar(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """A series' columns with one row per period from its first to its last, NaN where one is missing."""
    period = pdf["period"].to_numpy(np.int64)
    out = np.full((int(period.max() - period.min()) + 1 if len(period) else 0, len(columns)), np.nan)
    out[period - period.min() if len(period) else period] = pdf[columns].to_numpy(float)
    return out


def no_nan(frame: pd.DataFrame) -> pd.DataFrame:
    """NaN as NULL."""
    return frame.astype(object).where(frame.notna(), None)


def design(values: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (1, lag blocks) and targets of the rows without missing values."""
    t = len(values)
    blocks = [values[p - i - 1 : t - i - 1] for i in range(p)]
    x = np.hstack([np.ones((t - p, 1)), *blocks]) if t > p else np.empty((0, 1 + p * values.shape[1]))
    y = values[p:]
    good = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
    return x[good], y[good]


def unit_scale(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns divided by their standard deviation, so that units do not decide what is singular."""
    sd = np.nanstd(values, axis=0)
    sd = np.where(np.isfinite(sd) & (sd > 0), sd, 1.0)
    return values / sd, sd


def causality_tests(panel: DataFrame, keys: list[str], columns: list[str], p: int) -> DataFrame:
    """Joint Granger tests in a VAR with heteroskedasticity-consistent covariance (HC3).

    Per series: each variable on all others, all others on each variable.
    """
    k = len(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = design(unit_scale(on_calendar(pdf, columns))[0], p)
        n, z = x.shape
        if n <= z:
            return pd.DataFrame(columns=[*keys, "direction", "series", "f_stat", "df1", "df2", "p_value"])
        inv = np.linalg.pinv(x.T @ x)
        b = inv @ x.T @ y
        leverage = np.einsum("ij,jk,ik->i", x, inv, x)
        u = (y - x @ b) / np.maximum(1.0 - leverage, 1e-8)[:, None]
        scores = (u[:, :, None] * x[:, None, :]).reshape(n, k * z)
        bread = np.kron(np.eye(k), inv)
        cov = bread @ (scores.T @ scores) @ bread
        vec = b.T.reshape(-1)
        rows = []
        for i, c in enumerate(columns):
            others = [j for j in range(k) if j != i]
            for direction, causes, effects in (("one_to_others", [i], others), ("others_to_one", others, [i])):
                index = [e * z + 1 + lag * k + s for e in effects for lag in range(p) for s in causes]
                part = cov[np.ix_(index, index)]
                f = float(vec[index] @ np.linalg.pinv(part) @ vec[index]) / len(index)
                df2 = k * n - len(vec)
                rows.append((direction, c, f, float(len(index)), float(df2), float(f_tail(f, float(len(index)), float(df2)))))
        out = pd.DataFrame(rows, columns=["direction", "series", "f_stat", "df1", "df2", "p_value"])
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "direction", "series", "f_stat", "df1", "df2", "p_value"]]

    schema = f"{key_schema(panel, keys)}, direction string, series string, f_stat double, df1 double, df2 double, p_value double"
    return per_series(panel.select(*keys, "period", *columns), keys, run, schema)


def system_portmanteau(panel: DataFrame, keys: list[str], columns: list[str], p: int, lags: list[int]) -> DataFrame:
    """Box-Pierce, Ljung-Box and Hosking statistics of VAR residuals for several lag counts."""
    k = len(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = unit_scale(on_calendar(pdf, columns))[0]
        x, y = design(values, p)
        n = len(x)
        names = ["lags", "df", "box_pierce", "ljung_box", "hosking", "p_box_pierce", "p_ljung_box", "p_hosking"]
        if n <= x.shape[1]:
            out = pd.DataFrame([(h, float(k * k * (h - p)), *[None] * 6) for h in lags], columns=names)
            return out.assign(**{key: pdf[key].iloc[0] for key in keys})[[*keys, *names]]
        good = np.array([np.isfinite(values[t - p : t + 1]).all() for t in range(p, len(values))])
        u = np.zeros((len(good), k))
        u[good] = y - x @ (np.linalg.pinv(x) @ y)  # a missing residual adds nothing to a product
        inv = np.linalg.pinv(u.T @ u / n)
        products = (u[j:].T @ u[: max(0, len(u) - j)] / n if j < len(u) else np.zeros((k, k)) for j in range(1, max(lags) + 1))
        traces = np.array([np.trace(c.T @ inv @ c @ inv) for c in products])
        steps = np.arange(1, max(lags) + 1)
        rows = []
        for h in lags:
            df = k * k * (h - p)
            if h >= n or df <= 0:  # more lags than residuals
                rows.append((h, float(df), *[None] * 6))
                continue
            tr, j = traces[:h], steps[:h]
            stats = (n * tr.sum(), (n * (n + 2) * tr / (n - j)).sum(), (n * n * tr / (n - j)).sum())
            rows.append((h, float(df), *stats, *(float(gamma_tail(df / 2.0, s / 2.0)) for s in stats)))
        out = no_nan(pd.DataFrame(rows, columns=names))
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, *names]]

    fields = "lags int, df double, box_pierce double, ljung_box double, hosking double, p_box_pierce double, p_ljung_box double, p_hosking double"
    return per_series(panel.select(*keys, "period", *columns), keys, run, f"{key_schema(panel, keys)}, {fields}")


def var_order(panel: DataFrame, keys: list[str], columns: list[str], max_p: int = 10) -> DataFrame:
    """AIC, HQ, SC and FPE of VAR(1..max_p) on the sample common to all orders.

    Taking the lag blocks out of one moment matrix, one after the other, leaves every order's residual covariance.
    """
    k = len(columns)
    size = 1 + k * (max_p + 1)

    def design(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), *[x[:, i] for i in range(1, max_p + 1)], x[:, 0]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["moments"], size)
        n = m[:, 0, 0]
        left, out = sweep_out(m, m, 0), []
        for p in range(1, max_p + 1):
            for j in range(1 + k * (p - 1), 1 + k * p):
                left = sweep_out(left, m, j)
            with np.errstate(all="ignore"):
                sign, logdet = np.linalg.slogdet(left[:, -k:, -k:] / n[:, None, None])
                each = {c: logdet + weight * p * k * k / n for c, weight in (("aic", 2.0), ("hq", 2 * np.log(np.log(n))), ("sc", np.log(n)))}
                fpe = ((n + k * p + 1) / (n - k * p - 1)) ** k * np.exp(logdet)
            out.append(pdf[keys].assign(p=p, **each, fpe=fpe)[(n > 1 + k * p) & (sign > 0)])
        return pd.concat(out)

    fields = "p int, aic double, hq double, sc double, fpe double"
    scored = map_rows(lag_moments(panel, keys, columns, max_p, design, size), run, f"{key_schema(panel, keys)}, {fields}")
    w = W.partitionBy(*keys)
    return scored.withColumns({f"best_{c}": F.min_by("p", c).over(w) for c in ("aic", "hq", "sc", "fpe")})


# Published critical values of the trace statistic without deterministic term in
# the cointegration relation (Osterwald-Lenum 1992), by number of remaining relations 1..6.
JOHANSEN_TRACE = {
    0.10: [6.50, 15.66, 28.71, 45.23, 66.49, 85.18],
    0.05: [8.18, 17.95, 31.52, 48.28, 70.60, 90.39],
    0.01: [11.65, 23.52, 37.22, 55.43, 78.87, 104.20],
}


def johansen_trace(panel: DataFrame, keys: list[str], columns: list[str], order: int = 2) -> DataFrame:
    """Trace statistics in the long-run form: differences on level lag ``order``, given lagged differences.

    All product moments come from one matrix of sums per series.
    """
    k = len(columns)
    given = 1 + k * (order - 1)
    size = given + 2 * k

    def design(x: np.ndarray) -> np.ndarray:
        steps = x[:, :-1] - x[:, 1:]
        return np.hstack([np.ones((len(x), 1)), *[steps[:, i] for i in range(1, order)], steps[:, 0], x[:, order]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(pdf["moments"], size)
        left = m
        for j in range(given):
            left = sweep_out(left, m, j)
        out = []
        for name, n, s in zip(pdf[keys].itertuples(index=False, name=None), m[:, 0, 0], left[:, given:, given:]):
            lam = np.full(k, np.nan)
            if n > 1 + k * order:  # long enough for its own regressors
                scale = np.sqrt(np.maximum(np.diag(s), 0.0))
                scale = np.where(scale > 0, scale, 1.0)
                s = s / np.outer(scale, scale)
                values = np.linalg.eigvals(np.linalg.pinv(s[k:, k:]) @ s[k:, :k] @ np.linalg.pinv(s[:k, :k]) @ s[:k, k:])
                lam = np.clip(np.sort(values.real)[::-1], 0.0, 1.0 - 1e-12)
            for r in range(k):
                crit = [JOHANSEN_TRACE[a][k - r - 1] if k - r <= 6 and n > 1 + k * order else np.nan for a in (0.10, 0.05, 0.01)]
                out.append((*name, r, float(lam[r]), float(-n * np.log1p(-lam[r:]).sum()), *crit))
        return no_nan(pd.DataFrame(out, columns=[*keys, "rank", "eigenvalue", "trace", "crit10", "crit5", "crit1"]))

    fields = "rank int, eigenvalue double, trace double, crit10 double, crit5 double, crit1 double"
    return map_rows(lag_moments(panel, keys, columns, order, design, size), run, f"{key_schema(panel, keys)}, {fields}")
