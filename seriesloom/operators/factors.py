"""Correlation, principal components and factor-augmented models.

Rows of any number are reduced to a k x k cross-product matrix: one dense partial product per task,
added up by a grouped sum. Only that matrix is decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.tails import t_tail
from seriesloom.operators.moments import map_rows, per_series
from seriesloom.operators.systems import FORECAST_FIELDS, companion_forecast, key_schema, no_nan, on_calendar, to_records


def gram(df: DataFrame, vector: str, size: int, key: str | None = None) -> DataFrame:
    """Sums of products of (1, vector - centre) as one array of upper-triangle cells per key.

    The centre is the least vector of the data; it only keeps the sums near zero and is returned
    beside them. A vector of another length than ``size`` raises; one holding NaN is left out and
    does not count in ``n``.

    ``key`` must have few values (folds, say): each task keeps and emits one matrix per key.
    """
    rows, cols = np.triu_indices(size + 1)
    source = df.select(*([key] if key else []), vector).filter(F.col(vector).isNotNull())

    least, shortest, longest = source.agg(F.min(vector), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least is not None and not shortest == longest == size:
        raise ValueError(f"vectors have {shortest} to {longest} entries, not {size}")
    centre = np.zeros(size) if least is None else np.nan_to_num(np.asarray(least, dtype=float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby(key) if key else [(0, batch)]:
                x = np.column_stack([np.ones(len(part)), np.stack(part[vector].to_numpy()).astype(float) - centre])
                x = x[np.isfinite(x).all(axis=1)]
                sums[int(name)] = sums.get(int(name), 0.0) + x.T @ x
        for name, product in sums.items():
            yield pd.DataFrame({"k": name, "cell": np.arange(len(rows)), "value": product[rows, cols]})

    cells = source.mapInPandas(run, "k int, cell int, value double")
    summed = cells.groupBy("k", "cell").agg(F.sum("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("cell", "value")))
    out = summed.groupBy("k").agg(F.transform(ordered, lambda c: c["value"]).alias("moments"))
    return out.withColumn("centre", F.array(*[F.lit(float(c)) for c in centre]))


def matrix(values, size: int) -> np.ndarray:
    out = np.empty((size + 1, size + 1))
    rows, cols = np.triu_indices(size + 1)
    out[rows, cols] = values
    out[cols, rows] = values
    return out


def correlation(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Count, means, standard deviations (n - 1) and correlation from a cross-product matrix."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    with np.errstate(all="ignore"):
        corr = cov / np.outer(sd, sd)
    return n, mean, sd, corr


def components(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and loadings whose largest element is positive."""
    usable = np.isfinite(np.diag(corr))
    values, vectors = np.linalg.eigh(np.where(np.isfinite(corr), corr, 0.0))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    peak = np.argmax(np.abs(vectors), axis=0)
    vectors = vectors * np.sign(vectors[peak, np.arange(vectors.shape[1])])
    vectors[~usable] = 0.0
    return values, vectors


def correlation_rows(moments: DataFrame, size: int) -> DataFrame:
    """Pairs ``a <= b`` of columns (1-based) with correlation, t statistic and two-sided p-value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for k, values in zip(pdf["k"], pdf["moments"]):
            n, _, _, corr = correlation(matrix(values, size))
            a, b = np.triu_indices(size)
            r = np.clip(corr[a, b], -1.0, 1.0)
            with np.errstate(all="ignore"):
                t = r * np.sqrt((n - 2) / (1 - r * r))
            p = np.where(np.isfinite(t), 2 * t_tail(np.abs(np.where(np.isfinite(t), t, 0.0)), max(n - 2, 1.0)), 0.0)
            parts.append(pd.DataFrame({"k": k, "a": a + 1, "b": b + 1, "n": int(n), "r": r, "t": t, "p_value": p}))
        return pd.concat(parts)

    out = map_rows(moments, run, "k int, a int, b int, n bigint, r double, t double, p_value double")
    return out.withColumn("t", F.when((F.col("a") != F.col("b")) & (F.abs("t") < 1e300), F.col("t")))


def explained(moments: DataFrame, size: int, top: int) -> DataFrame:
    """Eigenvalue and explained shares of the leading components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for k, values in zip(pdf["k"], pdf["moments"]):
            lam, _ = components(correlation(matrix(values, size))[3])
            share = lam / lam.sum()
            parts.append(
                pd.DataFrame({"k": k, "component": np.arange(1, size + 1), "eigenvalue": lam, "pve": share, "cum_pve": share.cumsum()})[:top]
            )
        return pd.concat(parts)

    return map_rows(moments, run, "k int, component int, eigenvalue double, pve double, cum_pve double")


def loading_rows(moments: DataFrame, size: int, top: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for k, values in zip(pdf["k"], pdf["moments"]):
            _, vectors = components(correlation(matrix(values, size))[3])
            for c in range(top):
                parts.append(pd.DataFrame({"k": k, "feature": np.arange(1, size + 1), "component": c + 1, "loading": vectors[:, c]}))
        return pd.concat(parts)

    return map_rows(moments, run, "k int, feature int, component int, loading double")


def loading_matrix(moments: DataFrame, size: int) -> DataFrame:
    """All loadings as one value: per feature its weights on every component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"w": [[list(row) for row in components(correlation(matrix(v, size))[3])[1]] for v in pdf["moments"]]})

    return map_rows(moments, run, "w array<array<double>>")


def projection(moments: DataFrame, size: int, top: int) -> DataFrame:
    """The affine map to scores, one row: weights per component and their offset."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for values, centre in zip(pdf["moments"], pdf["centre"]):
            _, mean, sd, corr = correlation(matrix(values, size))
            _, vectors = components(corr)
            with np.errstate(all="ignore"):
                weights = np.where(sd[:, None] > 0, vectors[:, :top] / sd[:, None], 0.0).T
            out.append({"w": [list(w) for w in weights], "o": list(weights @ (mean + np.asarray(centre)))})
        return pd.DataFrame(out)

    mapped = map_rows(moments, run, "w array<array<double>>, o array<double>")
    return mapped.select(F.struct("w", "o").alias("map"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def scores(df: DataFrame, vector: str, moments: DataFrame, size: int, top: int) -> DataFrame:
    """Component scores of every row. The map is a scalar subquery of k x top numbers."""
    mapped = df.withColumn("_map", projection(moments, size, top).scalar())
    values = F.transform(F.sequence(F.lit(0), F.lit(top - 1)), lambda i: dot(F.col(vector), F.col("_map.w")[i]) - F.col("_map.o")[i])
    return mapped.withColumn("scores", values).drop("_map")


# --- principal-component regression, cross-validated from fold moments ---------------------


def pcr_cv(moments: DataFrame, size: int, max_r: int) -> DataFrame:
    """RMSE of regressing the last vector element on 1..max_r components of the others, per held-out fold.

    ``moments`` has one matrix per fold. Training moments are the total minus the fold, and the
    squared error on the fold follows from its own moments, so rows are read once for all folds
    and all numbers of components. Test rows are centred and scaled by training values.
    """
    joined = moments.withColumn("_all", F.lit(1)).groupBy("_all").agg(F.array_sort(F.collect_list(F.struct("k", "moments"))).alias("folds"))
    x = size - 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for folds in pdf["folds"]:
            mats = {int(f["k"]): matrix(f["moments"], size) for f in folds}
            total = sum(mats.values())
            for k, test in mats.items():
                train = total - test
                n, mean, sd, corr = correlation(train)
                _, vectors = components(corr[:x, :x])
                for r in range(1, max_r + 1):
                    weights = vectors[:, :r] / sd[:x, None]
                    basis = np.zeros((x + 1, r + 1))
                    basis[0, 0], basis[0, 1:], basis[1:, 1:] = 1.0, -mean[:x] @ weights, weights
                    gamma = np.linalg.lstsq(basis.T @ train[: x + 1, : x + 1] @ basis, basis.T @ train[: x + 1, x + 1], rcond=None)[0]
                    beta = basis @ gamma
                    sse = test[x + 1, x + 1] - 2 * beta @ test[: x + 1, x + 1] + beta @ test[: x + 1, : x + 1] @ beta
                    rows.append((k, r, int(test[0, 0]), float(np.sqrt(max(sse, 0.0) / test[0, 0]))))
        return pd.DataFrame(rows, columns=["fold", "r", "n_test", "rmse"])

    return map_rows(joined.select("folds"), run, "fold int, r int, n_test bigint, rmse double")


# --- factor-augmented autoregression -------------------------------------------------------


class ExpandingFactors:
    """Sums of products of a growing sample, from which components and the system on them are read at any origin.

    ``data`` has the target first, then the features, a row per period. Two matrices grow by one period at a time: of the
    features, and of all columns beside their ``p`` lags. Scores are linear in the features, so the moments of
    the system on target and scores are a projection of the second matrix, and no period is gone through again.
    """

    def __init__(self, data: np.ndarray, p: int):
        seen = np.isfinite(data)
        # a shift by the first value keeps the digits that carry the variation
        first = np.array([c[m][0] if m.any() else 0.0 for c, m in zip(data.T, seen.T)])
        self.data, self.first, self.p, self.rows = data - first, first, p, 0
        k = data.shape[1]
        self.features = np.zeros((k, k))
        self.system = np.zeros((1 + k * (p + 1),) * 2)
        self.complete = 0

    def advance(self, rows: int) -> None:
        """Take in the periods up to ``rows``."""
        for t in range(self.rows, min(rows, len(self.data))):
            x = np.concatenate([[1.0], self.data[t, 1:]])
            if np.isfinite(x).all():
                self.features += np.outer(x, x)
                self.complete += bool(np.isfinite(self.data[t, 0]))
            if t >= self.p:
                w = np.concatenate([[1.0], *(self.data[t - i] for i in range(self.p + 1))])
                if np.isfinite(w).all():
                    self.system += np.outer(w, w)
        self.rows = rows

    def loadings(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Constant and weights that make the first ``r`` scores of (shifted) features."""
        _, mean, sd, _ = correlation(self.features)
        keep = sd > 1e-12 * np.maximum(1.0, np.abs(mean))
        part = np.concatenate([[0], 1 + np.flatnonzero(keep)])
        _, mean, sd, corr = correlation(self.features[np.ix_(part, part)])
        weights = np.zeros((len(keep), min(r, int(keep.sum()))))
        weights[keep] = components(np.atleast_2d(corr))[1][:, :r] / sd[:, None]
        return -mean @ weights[keep], weights

    def forecast(self, loadings: tuple[np.ndarray, np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Means and standard errors of the target; None with too few rows or a hole in the last periods."""
        constant, weights = loadings
        p, k, size = self.p, self.data.shape[1], 1 + weights.shape[1]
        last = self.data[self.rows - p : self.rows] if self.rows >= p else self.data[:0]
        n, z = int(self.system[0, 0]), 1 + size * p
        if n <= z or len(last) < p or not np.isfinite(last).all():
            return None
        basis = np.zeros((1 + k * (p + 1), 1 + size * (p + 1)))
        basis[0, 0] = 1.0
        for i in range(p + 1):
            at, to = 1 + k * i, 1 + size * i
            basis[at, to], basis[0, to + 1 : to + size] = 1.0, constant
            basis[at + 1 : at + k, to + 1 : to + size] = weights
        m = basis.T @ self.system @ basis
        x, y = np.r_[0, 1 + size : m.shape[0]], np.arange(1, 1 + size)
        # columns of unit length before the solution, so that units do not decide what is singular
        scale = np.sqrt(np.maximum(np.diag(m)[x], 1e-300))
        coef = np.linalg.lstsq(m[np.ix_(x, x)] / np.outer(scale, scale), m[np.ix_(x, y)] / scale[:, None], rcond=1e-13)[0] / scale[:, None]
        rss = m[np.ix_(y, y)] - coef.T @ m[np.ix_(x, y)]
        state = np.column_stack([last[:, 0], constant + last[:, 1:] @ weights])[::-1].reshape(1, -1)
        mean, se = companion_forecast(coef[None], ((rss + rss.T) / 2 / (n - z))[None], state, p, steps)
        return mean[0, :, 0] + self.first[0], se[0, :, 0]


def favar_backtest(
    panel: DataFrame, keys: list[str], target: str, features: list[str], r: int, p: int, model: str, cut: int, last: int,
    horizons: tuple[int, ...] = (1, 4),
) -> DataFrame:
    """At every origin: components of the features up to it, then a VAR(p) of target and r scores.

    Both come from sums of products that grow with the origins.

    The period itself is never a variable. A series' own rows are all a task needs. An origin whose
    last ``p`` periods have a hole, or with too few complete rows before it, gets a NULL forecast.
    """
    steps = max(horizons)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, begin = on_calendar(pdf, [target, *features]), int(pdf["period"].min())
        truth = dict(zip(pdf["period"], pdf[target]))
        rows = []
        sample = ExpandingFactors(data, p)
        for origin in range(max(begin, cut + 1 - steps), last - min(horizons) + 1):
            sample.advance(origin - begin + 1)
            made = None
            if origin < begin + len(data) and sample.complete >= max(10, 2 + p * (r + 1) * 2):
                made = sample.forecast(sample.loadings(r), steps)
            for h in horizons:
                mean, se = (made[0][h - 1], made[1][h - 1]) if made is not None else (np.nan, np.nan)
                rows.append((origin, h, truth.get(origin + h, np.nan), mean, se))
        out = no_nan(pd.DataFrame(rows, columns=["training_end", "periods_ahead", "true_value", "mean", "se"]))
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "training_end", "periods_ahead", "true_value", "mean", "se"]]

    source = panel.select(*keys, "period", target, *features)
    out = per_series(source, keys, run, f"{key_schema(source, keys)}, {FORECAST_FIELDS}")
    end = F.col("training_end") + F.col("periods_ahead")
    return to_records(out.filter(end.between(cut + 1, last)), keys, model)


def factor_cv(
    panel: DataFrame, keys: list[str], target: str, features: list[str], max_r: int, p: int = 1, go_back: int = 51, skip: int = 5
) -> DataFrame:
    """Growing-window choice of the number of factors: one-step errors per series, fold and r.

    Fold i trains on the first ``n - go_back + skip * i`` periods and tests on the next one. A fold too
    short to fit, or whose last periods have a hole, gets a NULL forecast.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = on_calendar(pdf, [target, *features])
        whole = np.flatnonzero(np.isfinite(data).all(axis=1))
        data = data[whole[0] : whole[-1] + 1] if whole.size else data[:0]
        n = len(data)
        rows = []
        sample = ExpandingFactors(data, p)
        for i in range(1, (go_back - 1) // skip + 1):
            size = n - go_back + skip * i
            sample.advance(max(size, 0))
            enough = sample.complete >= max(3, 4 * (max_r + 2) // 2)
            constant, weights = sample.loadings(max_r) if enough else (None, None)
            truth = data[size, 0] if 0 <= size < n else np.nan
            for r in range(1, max_r + 1):
                made = sample.forecast((constant[:r], weights[:, :r]), 1) if enough else None
                forecast = np.nan if made is None else made[0][0]
                rows.append((i, r, truth, forecast, forecast - truth))
        out = no_nan(pd.DataFrame(rows, columns=["fold", "r", "true_value", "forecast", "error"]))
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "fold", "r", "true_value", "forecast", "error"]]

    source = panel.select(*keys, "period", target, *features)
    fields = "fold int, r int, true_value double, forecast double, error double"
    return per_series(source, keys, run, f"{key_schema(source, keys)}, {fields}")
