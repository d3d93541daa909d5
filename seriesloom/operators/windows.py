"""Lags, growth, running and ranked results.

Windows over a series are bounded by its calendar. Extremes and ranks over whole record tables
go through grouped aggregates instead, so that a dominant group is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.scalars import ratio
from seriesloom.operators.joins import attach_group_stats
from seriesloom.operators.reshape import by_period


def lagged(value: str, keys: list[str], k: int = 1) -> Column:
    return F.lag(value, k).over(by_period(keys))


def at_lag(value: str, keys: list[str], k: int = 1) -> Column:
    """The value exactly ``k`` periods earlier, NULL where that period is missing: no lag jumps a hole."""
    return F.first(value).over(W.partitionBy(*keys).orderBy("period").rangeBetween(-k, -k))


def growth(value: str, keys: list[str]) -> Column:
    """Discrete growth in percent."""
    return 100.0 * (ratio(F.col(value), lagged(value, keys)) - 1.0)


def annualised_growth(value: str, keys: list[str], per_year: int = 4) -> Column:
    return 100.0 * (F.pow(ratio(F.col(value), lagged(value, keys)), F.lit(float(per_year))) - 1.0)


def deannualise(rate: Column, per_year: int = 4) -> Column:
    return 100.0 * (F.pow(1.0 + rate / 100.0, F.lit(1.0 / per_year)) - 1.0)


def difference(value: str, keys: list[str], order: int = 1) -> Column:
    if order == 1:
        return F.col(value) - lagged(value, keys)
    return F.col(value) - 2 * lagged(value, keys) + lagged(value, keys, 2)


def lag_frame(df: DataFrame, keys: list[str], target: str, features: list[str], horizon: int, max_lag: int = 1) -> DataFrame:
    """Target with lags ``horizon .. horizon + max_lag - 1`` of itself and of every feature.

    Contemporaneous features are dropped. One window serves all lags. Needs complete calendars.
    """
    ks = range(horizon, horizon + max_lag)
    lags = [lagged(c, keys, k).alias(f"{c}_l{k}") for c in [target, *features] for k in ks]
    return df.select(*keys, "period", target, *lags)


def lag_rows(df: DataFrame, keys: list[str], series: str, value: str, ks: list[int]) -> DataFrame:
    """The same lags in long form: each observation is emitted at the periods it is a lag of."""
    shifted = df.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in ks])))
    return shifted.select(*keys, (F.col("period") + F.col("lag")).alias("period"), series, "lag", F.col(value).alias("lag_value"))


def revision_flag(value: str, keys: list[str], order: str) -> Column:
    """Whether a value differs from its predecessor; the first row counts as unrevised."""
    previous = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return F.when(previous.isNotNull() & (F.col(value) != previous), F.lit("yes")).otherwise(F.lit("no"))


def expanding(keys: list[str]):
    return by_period(keys).rowsBetween(W.unboundedPreceding, 0)


def trailing(keys: list[str], width: int):
    return by_period(keys).rowsBetween(-(width - 1), 0)


def top_with_ties(df: DataFrame, keys: list[str], value: str, n: int, smallest: bool = True) -> DataFrame:
    """The ``n`` best rows per group, keeping every row tied with the last of them.

    Ties may be many, so rows are not ranked. Distinct values are counted, at most ``n`` of them
    per group survive the limited rank, and their running count gives the cut-off value.
    """
    direction = F.col(value).asc() if smallest else F.col(value).desc()
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys).orderBy(direction)
    best = distinct.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    before = F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    inside = best.withColumn("_before", before).filter(F.col("_before") < n)
    cutoff = inside.groupBy(*keys).agg((F.max(value) if smallest else F.min(value)).alias("_cut"))
    kept = attach_group_stats(df, cutoff, keys)
    keep = F.col(value) <= F.col("_cut") if smallest else F.col(value) >= F.col("_cut")
    return kept.filter(keep).drop("_cut")


def minmax_rescale(df: DataFrame, keys: list[str], value: str, name: str = "rescaled") -> DataFrame:
    """Rescale to [0, 1] within each group by its aggregated extremes."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return (
        attach_group_stats(df, span, keys)
        .withColumn(name, ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")))
        .drop("_lo", "_hi")
    )


def dual_axis(df: DataFrame, keys: list[str], primary: str, secondary: str, name: str = "scaled") -> DataFrame:
    """Map the range of ``secondary`` linearly onto that of ``primary`` (ranges widened to integers).

    A window over the whole series: its length is that of the calendar.
    """
    w = W.partitionBy(*keys)
    p_lo, p_hi = F.floor(F.min(primary).over(w)), F.ceil(F.max(primary).over(w))
    s_lo, s_hi = F.ceil(F.min(secondary).over(w)), F.ceil(F.max(secondary).over(w))
    slope = ratio(p_hi - p_lo, s_hi - s_lo)
    return df.withColumn(name, p_lo - slope * s_lo + slope * F.col(secondary))


def zscore(df: DataFrame, keys: list[str], value: str, training: Column | None = None, name: str = "z") -> DataFrame:
    """Standardise each series by its own, or only its training rows', mean and deviation."""
    w = W.partitionBy(*keys)
    used = F.col(value) if training is None else F.when(training, F.col(value))
    return df.withColumn(name, ratio(F.col(value) - F.avg(used).over(w), F.stddev_samp(used).over(w)))


def ratio_to_benchmark(metrics: DataFrame, keys: list[str], model: str, benchmark: Column, value: str) -> DataFrame:
    """``relative`` = value / benchmark's value, ``gain`` = 1 - value / benchmark's value.

    ``metrics`` has one row per model, so the self join is on result rows only.
    """
    base = metrics.filter(F.col(model) == benchmark).select(*keys, F.col(value).alias("_base"))
    return (
        metrics.join(base, keys, "left")
        .withColumn("relative", ratio(F.col(value), F.col("_base")))
        .withColumn("gain", 1.0 - F.col("relative"))
        .drop("_base")
    )
