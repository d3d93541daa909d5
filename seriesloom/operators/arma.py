"""ARMA models by conditional sum of squares, many series and origins at a time.

A row is one (series, origin) or one (series, order); rows of an Arrow batch are fitted together,
so the recursion over time is the only Python loop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.operators.moments import map_rows, spread
from seriesloom.operators.systems import FORECAST_FIELDS, key_schema, to_records


def live_mask(y: np.ndarray, n: np.ndarray, start: int, lags: int) -> np.ndarray:
    """Times with an observation and all its lags: a hole is skipped, never closed up."""
    seen = np.isfinite(y) & (np.arange(y.shape[1])[None, :] < n[:, None])
    live = seen.copy()
    for i in range(1, lags + 1):
        live[:, i:] &= seen[:, :-i]
        live[:, :i] = False
    live[:, :start] = False
    return live


def css_residuals(y: np.ndarray, live: np.ndarray, params: np.ndarray, p: int, q: int) -> np.ndarray:
    """One-step errors given (mean, ar.., ma..) at live times, zero elsewhere."""
    count, t = y.shape
    z = np.nan_to_num(y) - params[:, :1]
    w = z.copy()
    for i in range(1, p + 1):
        w[:, i:] -= params[:, i : i + 1] * z[:, :-i]
    w = np.where(live, w, 0.0)
    if q == 0:
        return w
    theta = params[:, p + 1 : p + 1 + q]
    recent = np.zeros((count, q))
    e = np.zeros_like(w)
    with np.errstate(all="ignore"):
        for s in range(t):
            e[:, s] = np.where(live[:, s], w[:, s] - (theta * recent).sum(axis=1), 0.0)
            recent[:, 1:] = recent[:, :-1].copy()
            recent[:, 0] = e[:, s]
    return e


def css_derivatives(y: np.ndarray, live: np.ndarray, params: np.ndarray, e: np.ndarray, p: int, q: int) -> np.ndarray:
    """Derivatives of the one-step errors by every parameter, rows x time x parameters.

    Each obeys the recursion of the errors with its own input: the mean gives one less the
    autoregressive weights, a weight of lag i gives the value i steps back, one of a past error that error.
    """
    count, t = y.shape
    size = 1 + p + q
    z = np.nan_to_num(y) - params[:, :1]
    out = np.zeros((count, t, size))
    out[:, :, 0] = (params[:, 1 : 1 + p].sum(axis=1) - 1.0)[:, None]
    for i in range(1, p + 1):
        out[:, i:, i] = -z[:, :-i]
    for j in range(1, q + 1):
        out[:, j:, p + j] = -e[:, :-j]
    out *= live[:, :, None]
    if q:
        theta = params[:, p + 1 : p + 1 + q]
        seen = live[:, :, None].astype(float)
        with np.errstate(all="ignore"):
            for s in range(1, t):
                m = min(q, s)
                past = out[:, s - m : s][:, ::-1]
                out[:, s] -= seen[:, s] * np.matmul(theta[:, None, :m], past)[:, 0]
    return out


def starting_values(y: np.ndarray, p: int, q: int) -> np.ndarray:
    """Two regressions: a long autoregression for errors, then lags of values and errors."""
    mean = y.mean()
    z = y - mean
    n = len(z)
    out = np.zeros(1 + p + q)
    out[0] = mean
    if p + q == 0 or n < 2 * (p + q) + 4:
        return out
    m = min(max(p, q) + 2, n // 3)
    x = np.column_stack([z[m - i : n - i] for i in range(1, m + 1)])
    e = np.zeros(n)
    e[m:] = z[m:] - x @ np.linalg.lstsq(x, z[m:], rcond=None)[0]
    s = m + q
    cols = [z[s - i : n - i] for i in range(1, p + 1)] + [e[s - j : n - j] for j in range(1, q + 1)]
    beta = np.linalg.lstsq(np.column_stack(cols), z[s:], rcond=None)[0]
    if q and np.abs(beta[p:]).sum() >= 0.95:
        beta[p:] *= 0.9 / np.abs(beta[p:]).sum()
    out[1:] = beta
    return out


def fit_css(
    y: np.ndarray, n: np.ndarray, p: int, q: int, start: int | None = None, rounds: int = 300, lags: int | None = None, orders: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, residuals, sums of squares and whether each row settled, by damped Gauss-Newton steps on all rows at once.

    ``orders`` gives each row its own order up to (p, q), rows x 2; the weights beyond it stay zero.
    """
    live = live_mask(y, n, p if start is None else start, p if lags is None else lags)
    own = np.tile([p, q], (len(y), 1)) if orders is None else orders
    params = np.zeros((len(y), 1 + p + q))
    free = np.zeros(params.shape, bool)
    for k, (row, size, (a, m)) in enumerate(zip(y, n, own)):
        at = np.concatenate([[0], 1 + np.arange(a), 1 + p + np.arange(m)])
        params[k, at], free[k, at] = starting_values(row[:size][np.isfinite(row[:size])], a, m), True

    def loss(theta):
        e = css_residuals(y, live, theta, p, q)
        with np.errstate(all="ignore"):
            s = (e * e).sum(axis=1)
        return e, np.where(np.isfinite(s), s, np.inf)

    plain = params.copy()
    plain[:, 1:] = 0.0
    e, best = loss(params)
    _, flat = loss(plain)
    worse = ~(best <= flat)
    params[worse] = plain[worse]
    e, best = loss(params)
    size = params.shape[1]
    damping = np.full(len(y), 1e-3)
    active = np.ones(len(y), dtype=bool)
    for _ in range(rounds):
        i = np.flatnonzero(active)
        if not len(i):
            break
        jac = np.nan_to_num(css_derivatives(y[i], live[i], params[i], e[i], p, q), posinf=0.0, neginf=0.0) * free[i][:, None, :]
        across = np.transpose(jac, (0, 2, 1))
        g = np.matmul(across, e[i][:, :, None])[:, :, 0]
        h = np.matmul(across, jac)
        diag = np.maximum(np.einsum("bii->bi", h), 1e-12)
        h[:, np.arange(size), np.arange(size)] += damping[i, None] * diag + 1e-12
        trial = params[i] - np.linalg.solve(h, g[:, :, None])[:, :, 0]
        e_new = css_residuals(y[i], live[i], trial, p, q)
        with np.errstate(all="ignore"):
            s_new = (e_new * e_new).sum(axis=1)
        ok = s_new < best[i]
        gain = np.where(ok, (best[i] - s_new) / np.maximum(best[i], 1e-300), np.inf)
        took = i[ok]
        params[took], e[took], best[took] = trial[ok], e_new[ok], s_new[ok]
        damping[i] = np.where(ok, np.maximum(damping[i] / 5, 1e-9), damping[i] * 8)
        # a row ends by its own progress only, so that its neighbours in the batch do not matter
        active[i] = (gain > 1e-10) & (damping[i] < 1e8)
    return params, e, best, ~active


ROWS_AT_ONCE = 256


def fit_many(
    y: np.ndarray, n: np.ndarray, p: int, q: int, start: int | None = None, rounds: int = 300, lags: int | None = None, orders: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`fit_css` in slices, so that memory does not depend on the Arrow batch size."""
    slices = [slice(i, i + ROWS_AT_ONCE) for i in range(0, len(y), ROWS_AT_ONCE)]
    parts = [fit_css(y[c], n[c], p, q, start, rounds, lags, None if orders is None else orders[c]) for c in slices]
    return tuple(np.concatenate(column) for column in zip(*parts))


def forecast_css(y, n, params, e, p, q, steps) -> tuple[np.ndarray, np.ndarray]:
    """Means and psi-weight sums for ``1..steps`` ahead."""
    count = len(y)
    rows = np.arange(count)
    mu, phi, theta = params[:, 0], params[:, 1 : 1 + p], params[:, 1 + p :]
    z = [y[rows, n - 1 - i] - mu for i in range(p)]
    shocks = [e[rows, n - 1 - j] for j in range(q)]
    means = []
    for _ in range(steps):
        value = sum((phi[:, i] * z[i] for i in range(p)), np.zeros(count)) + sum((theta[:, j] * shocks[j] for j in range(q)), np.zeros(count))
        means.append(mu + value)
        z = [value, *z][:p]
        shocks = [np.zeros(count), *shocks][:q]
    psi = [np.ones(count)]
    for s in range(1, steps):
        value = theta[:, s - 1].copy() if s <= q else np.zeros(count)
        for i in range(1, min(p, s) + 1):
            value = value + phi[:, i - 1] * psi[s - i]
        psi.append(value)
    return np.stack(means, 1), np.cumsum(np.stack(psi, 1) ** 2, axis=1)


def _padded(arrays, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Rows from their first observation on, holes kept, padded at the end."""
    cleaned = []
    for a, s in zip(arrays, sizes):
        v = np.asarray(a, dtype=float)[: int(s)]
        seen = np.flatnonzero(np.isfinite(v))
        cleaned.append(v[seen[0] :] if len(seen) else v[:0])
    n = np.array([len(v) for v in cleaned])
    out = np.full((len(cleaned), max(1, n.max(initial=1))), np.nan)
    for row, v in zip(out, cleaned):
        row[: len(v)] = v
    return out, n


def series_arrays(panel: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per series: first period and values in time order (complete calendar, so position is time)."""
    return (
        panel.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("period", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v")))).alias("_d"))
        .select(*keys, F.col("_d")[0]["period"].alias("first"), F.transform("_d", lambda s: s["v"]).alias("values"))
    )


def arma_backtest(
    panel: DataFrame, keys: list[str], value: str, order: tuple[int, int], model: str, cut: int, last: int, horizons: tuple[int, ...] = (1, 4)
) -> DataFrame:
    """ARMA(p, q) with mean refitted at every origin."""
    p, q = order
    arrays = series_arrays(panel, keys, value)
    # an array crosses the shuffle once; its origins are laid out behind it
    origins = spread(arrays, keys).withColumn("training_end", F.explode(F.sequence(F.lit(cut + 1 - max(horizons)), F.lit(last - min(horizons)))))
    size = F.col("training_end") - F.col("first") + 1
    rows = origins.withColumn("size", size).filter((F.col("size") > 0) & (F.col("size") <= F.size("values")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, n = _padded(pdf["values"], pdf["size"])
        used = live_mask(y, n, p, p).sum(axis=1)
        enough = used >= p + q + 2
        parts = []
        if enough.any():
            some = pdf[enough]
            ys, ns = y[enough], n[enough]
            params, e, sse, _ = fit_many(ys, ns, p, q)
            mean, weight = forecast_css(ys, ns, params, e, p, q, max(horizons))
            sigma2 = sse / used[enough]
            for h in horizons:
                index = (some["size"] - 1 + h).to_numpy()
                truth = [v[i] if i < len(v) else np.nan for v, i in zip(some["values"], index)]
                parts.append(
                    some[keys].assign(
                        training_end=some["training_end"], periods_ahead=h, true_value=truth, mean=mean[:, h - 1],
                        se=np.sqrt(sigma2 * weight[:, h - 1]),
                    )
                )
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*keys, "training_end", "periods_ahead", "true_value", "mean", "se"])

    out = map_rows(rows, run, f"{key_schema(rows, keys)}, {FORECAST_FIELDS}")
    target = F.col("training_end") + F.col("periods_ahead")
    return to_records(out.filter(target.between(cut + 1, last)), keys, model)


def arma_orders(panel: DataFrame, keys: list[str], value: str, max_p: int = 10, max_q: int = 10) -> DataFrame:
    """AICc of every ARMA(p, q) up to the given orders on one common sample, with the best per series.

    Candidates are rows: (series, p) pairs spread over the cluster, each laid out over its range of q. Rows of
    all orders in a batch are fitted together, so the time steps of a batch are gone through once a round.
    """
    arrays = series_arrays(panel, keys, value)
    # an array crosses the shuffle once per p; its range of q is laid out behind it
    grid = spread(arrays.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(max_p)))), [*keys, "p"])
    spread_grid = grid.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max_q))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, n = _padded(pdf["values"], [len(v) for v in pdf["values"]])
        start = max(max_p, max_q)
        used = live_mask(y, n, start, max_p).sum(axis=1)
        orders = pdf[["p", "q"]].to_numpy(int)
        k = orders.sum(axis=1) + 2
        good = used - k - 1 > 0
        aicc, sigma, settled = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan), np.zeros(len(pdf), bool)
        if good.any():
            _, _, sse, settled[good] = fit_many(y[good], n[good], max_p, max_q, start, lags=max_p, orders=orders[good])
            u, k = used[good], k[good]
            with np.errstate(all="ignore"):
                sigma[good] = sse / u
                aicc[good] = u * (np.log(2 * np.pi * sse / u) + 1) + 2 * k + 2 * k * (k + 1) / (u - k - 1)
        return pdf[[*keys, "p", "q"]].assign(sigma2=sigma, aicc=aicc, converged=settled)

    scored = map_rows(spread_grid, run, f"{key_schema(grid, keys)}, p int, q int, sigma2 double, aicc double, converged boolean")
    usable = F.when((F.abs("aicc") < 1e300) & F.col("converged"), F.col("aicc"))
    w = W.partitionBy(*keys)
    return (
        scored.withColumn("aicc", usable)
        .withColumn("best_p", F.min_by("p", "aicc").over(w))
        .withColumn("best_q", F.min_by("q", "aicc").over(w))
    )
