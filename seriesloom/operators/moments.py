"""Cross-product moments and the small dense solves built on them.

Every linear model here needs only the sums of products of its columns. Spark forms them (grouped,
or over expanding windows, one row per origin); numpy then solves a batch of tiny systems per
Arrow batch. No model sees raw rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.operators.reshape import by_period

ONE = "_one"


def _value(name: str) -> Column:
    return F.lit(1.0) if name == ONE else F.col(name).cast("double")


def moment_array(columns: list[str], window=None, keep: Column | None = None) -> Column:
    """Upper triangle of the cross-product matrix as an array; incomplete rows add nothing."""
    named = [c for c in columns if c != ONE]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in named])
    if keep is not None:
        complete = complete & keep
    cells = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            cell = F.sum(F.when(complete, _value(a) * _value(b)))
            cells.append(cell.over(window) if window is not None else cell)
    return F.array(*cells)


def grouped_moments(df: DataFrame, keys: list[str], columns: list[str], keep: Column | None = None, *extra: Column) -> DataFrame:
    return df.groupBy(*keys).agg(moment_array(columns, keep=keep).alias("moments"), *extra)


def shift_to_start(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Subtract from each column its series' first observed value, kept as ``_s_<column>``.

    Sums of squares of values far from zero lose the digits that carry their variation, the more so
    the more records each cell averages. Slopes, fits and tests do not change under the shift, and
    the first value is known at every origin.
    """
    w = by_period(keys).rowsBetween(W.unboundedPreceding, 0)
    firsts = {f"_s_{c}": F.first(F.col(c).cast("double"), ignorenulls=True).over(w) for c in columns}
    return df.withColumns(firsts).withColumns({c: F.col(c) - F.col(f"_s_{c}") for c in columns})


def unpack(arrays: pd.Series, size: int) -> np.ndarray:
    """Stack of symmetric matrices from arrays of upper triangles; missing cells become NaN."""
    flat = np.array([np.full(size * (size + 1) // 2, np.nan) if a is None else np.asarray(a, dtype=float) for a in arrays])
    out = np.empty((len(flat), size, size))
    rows, cols = np.triu_indices(size)
    out[:, rows, cols] = flat
    out[:, cols, rows] = flat
    return out


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solution and inverse for a stack of normal equations; NaN where a system is singular."""
    count, size = a.shape[0], a.shape[1]
    inverse = np.full((count, size, size), np.nan)
    scale = np.sqrt(np.abs(np.einsum("bii->bi", a)))
    good = np.isfinite(a).all(axis=(1, 2)) & (scale > 0).all(axis=1)
    if good.any():
        s = scale[good]
        unit = a[good] / (s[:, :, None] * s[:, None, :])
        regular = np.linalg.cond(unit) < 1e13
        index = np.flatnonzero(good)[regular]
        if len(index):
            inverse[index] = np.linalg.inv(unit[regular]) / (s[regular][:, :, None] * s[regular][:, None, :])
    return np.einsum("bij,bjk->bik", inverse, b), inverse


def ols(m: np.ndarray, x: list[int], y: int) -> dict[str, np.ndarray]:
    """Least squares of column ``y`` on columns ``x`` for a stack of moment matrices with a
    constant in column 0 (used only to count rows)."""
    n = m[:, 0, 0]
    if x:
        beta, inverse = solve(m[:, x][:, :, x], m[:, x, y][:, :, None])
        beta = beta[:, :, 0]
        rss = m[:, y, y] - np.einsum("bi,bi->b", beta, m[:, x, y])
    else:
        beta, inverse, rss = np.zeros((len(m), 0)), np.zeros((len(m), 0, 0)), m[:, y, y].copy()
    rss = np.maximum(rss, 0.0)
    df = n - len(x)
    with np.errstate(all="ignore"):
        sigma2 = np.where(df > 0, rss / df, np.nan)
        se = np.sqrt(sigma2[:, None] * np.einsum("bii->bi", inverse)) if x else beta
    return {"beta": beta, "se": se, "rss": rss, "n": n, "df": df, "inverse": inverse, "sigma2": sigma2}


def sweep_out(left: np.ndarray, whole: np.ndarray, j: int) -> np.ndarray:
    """``left``, what remains of the moment matrices ``whole`` after earlier columns, without what column ``j`` explains.

    A column that those before it explain adds nothing.
    """
    pivot = left[:, j, j]
    with np.errstate(all="ignore"):
        scale = np.where(pivot > 1e-13 * whole[:, j, j], 1 / pivot, 0.0)
    return left - left[:, :, j, None] * (left[:, j] * scale[:, None])[:, None, :]


def nested_rss(m: np.ndarray, x: list[int], y: int) -> np.ndarray:
    """Residual sums of squares of column ``y`` on the first one, two, ... of the columns ``x``, for a stack of moment
    matrices: one factorisation gives all nested models."""
    left, out = m, []
    for j in x:
        left = sweep_out(left, m, j)
        out.append(np.maximum(left[:, y, y], 0.0))
    return np.stack(out, 1)


def lag_moments(
    panel: DataFrame, keys: list[str], columns: list[str], lags: int, design: Callable[[np.ndarray], np.ndarray], size: int
) -> DataFrame:
    """``keys, moments``: per series, the sums of products of the ``size`` columns that ``design`` makes of its rows.

    ``design`` gets values as (rows, 1 + lags, columns), the present first, shifted by each series' first value; only
    periods with ``lags`` complete periods right behind them count, and a series without any has zeros. Rows pass
    in Arrow batches and only one matrix is held, so a series may have any length.
    """
    w = W.partitionBy(*keys).orderBy("period").rangeBetween(-lags, 0)
    shifted = shift_to_start(panel.select(*keys, "period", *columns), keys, columns)
    now = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    behind = shifted.select(*keys, now.alias("_now"), "period").select(*keys, F.flatten(F.collect_list("_now").over(w)).alias("_behind"))
    width = len(columns) * (1 + lags)
    cells = np.triu_indices(size)

    def product(part: pd.Series) -> np.ndarray:
        whole = part[part.str.len() == width]
        if not len(whole):
            return np.zeros((size, size))
        x = np.stack(whole.to_numpy()).astype(float).reshape(len(whole), 1 + lags, len(columns))[:, ::-1]
        z = design(x[np.isfinite(x).all(axis=(1, 2))])
        return z.T @ z

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def give(names: list[tuple]) -> pd.DataFrame:
            found = pd.DataFrame(names, columns=keys, dtype=object)
            return found.assign(moments=[held.pop(name)[cells] for name in names])

        for batch in batches:
            for _, part in batch.groupby(keys, sort=False, dropna=False):
                name = tuple(part[keys].astype(object).iloc[0])
                held[name] = held.get(name, 0.0) + product(part["_behind"])
            # rows come series by series: only the last one may go on
            if done := list(held)[:-1]:
                yield give(done)
        if held:
            yield give(list(held))

    schema = ", ".join(f"{k} {panel.schema[k].dataType.simpleString()}" for k in keys)
    parts = behind.mapInPandas(run, f"{schema}, moments array<double>")
    zeros = F.array_repeat(F.lit(0.0), len(cells[0]))
    total = F.reduce(F.collect_list("moments"), zeros, lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
    return parts.groupBy(*keys).agg(total.alias("moments"))


def f_statistic(restricted: dict, full: dict, q: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(full["df"] > 0, ((restricted["rss"] - full["rss"]) / q) / (full["rss"] / full["df"]), np.nan)


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a vectorised function to Arrow batches of result rows, no shuffle involved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield fn(batch)

    return df.mapInPandas(run, schema)


def per_series(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to each series in time order. Its input is bounded by the calendar.

    The work is in the arithmetic, not in the bytes, so the partition count is explicit: adaptive
    execution would merge small partitions and leave most cores idle.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("period", ignore_index=True))

    return spread(df, keys).groupBy(*keys).applyInPandas(run, schema)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Repartition by key into no fewer partitions than the cluster has cores or the session asks for."""
    spark = df.sparkSession
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(asked, spark.sparkContext.defaultParallelism), *keys)


def lag_columns(df: DataFrame, keys: list[str], columns: list[str], lags: int) -> tuple[DataFrame, list[str]]:
    """Add ``c_l1 .. c_lp`` for every column, ordered lag first as in a companion form."""
    from seriesloom.operators.windows import lagged

    names = {f"{c}_l{k}": lagged(c, keys, k) for k in range(1, lags + 1) for c in columns}
    return df.withColumns(names), list(names)
