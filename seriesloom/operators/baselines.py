"""Forecasts that need nothing but expanding windows: random walk, mean and first-order AR.

Every period of a series is an origin. Estimates at an origin are window aggregates over its past,
so all origins of all series cost one sort and no refitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.scalars import band
from seriesloom.operators.reshape import by_period
from seriesloom.operators.windows import expanding

HORIZON_NAMES = {1: "Q", 4: "Y"}
RECORD_COLUMNS = (
    "model_id", "horizon", "training_end", "periods_ahead", "forecast_period",
    "true_value", "mean", "lower", "upper", "error", "strategy", "band_kind",
)


def _power_sum(base: Column, count: int) -> Column:
    total: Column = F.lit(1.0)
    for i in range(1, count):
        total = total + F.pow(base, F.lit(float(i)))
    return total


def random_walk(value: Column, mean_square_step: Column, h: int) -> tuple[Column, Column]:
    return value, F.sqrt(mean_square_step * h)


def ar_one(value: Column, slope: Column, intercept: Column, variance: Column, h: int) -> tuple[Column, Column]:
    """Iterated forecast; written without a long-run mean so that a unit slope is no special case."""
    mean = intercept * _power_sum(slope, h) + F.pow(slope, F.lit(float(h))) * value
    return mean, F.sqrt(variance * _power_sum(slope * slope, h))


def origin_estimates(panel: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per origin the estimates of all three models from data up to that origin."""
    w, e = by_period(keys), expanding(keys)
    pairs = panel.withColumn("_prev", F.lag(value).over(w))
    y, x = F.col(value), F.col("_prev")
    n = F.regr_count(y, x).over(e)
    enough = n >= 3
    return pairs.select(
        *keys,
        "period",
        y.alias("_y"),
        F.avg((y - x) * (y - x)).over(e).alias("_step2"),
        F.avg(y).over(e).alias("_mu"),
        F.stddev_pop(y).over(e).alias("_sd"),
        F.when(enough, F.regr_slope(y, x).over(e)).alias("_slope"),
        F.when(enough, F.regr_intercept(y, x).over(e)).alias("_icept"),
        F.when(enough, F.greatest(F.lit(0.0), F.regr_syy(y, x).over(e) * (1.0 - F.regr_r2(y, x).over(e)) / n)).alias("_var"),
    )


def as_records(
    origins: DataFrame,
    keys: list[str],
    forecasts: dict[tuple[str, int], tuple[Column, Column | None]],
    first_target: int,
    last_target: int,
    level: float = 95.0,
    strategy: str = "iterated",
) -> DataFrame:
    """Forecasts at every origin as rows of the common record.

    ``origins`` holds complete calendars with the target in ``_y``; the realised value is read
    ahead in the same window. A value beyond the data is NULL.
    """
    w = by_period(keys)
    steps = sorted({h for _, h in forecasts})
    ahead = origins.withColumns({f"_t{h}": F.lead("_y", h).over(w) for h in steps})
    cells = []
    for (model, h), (mean, se) in forecasts.items():
        name = HORIZON_NAMES.get(h, f"H{h}")
        cells.append(
            F.struct(
                F.lit(f"{model}_{name}").alias("model_id"),
                F.lit(name).alias("horizon"),
                F.lit(h).alias("periods_ahead"),
                F.col(f"_t{h}").alias("true_value"),
                mean.cast("double").alias("mean"),
                (F.lit(None) if se is None else se).cast("double").alias("se"),
            )
        )
    rows = ahead.select(*keys, F.col("period").alias("training_end"), F.explode(F.array(*cells)).alias("_f"))
    flat = rows.select(*keys, "training_end", "_f.*").withColumn(
        "forecast_period", (F.col("training_end") + F.col("periods_ahead")).cast("int")
    )
    lower, upper = band(F.col("mean"), F.col("se"), level)
    return (
        flat.filter(F.col("forecast_period").between(first_target, last_target))
        .withColumn("lower", lower)
        .withColumn("upper", upper)
        .withColumn("error", F.col("true_value") - F.col("mean"))
        .withColumn("strategy", F.lit(strategy))
        .withColumn("band_kind", F.lit(f"{level:g}%"))
        .select(*keys, *RECORD_COLUMNS)
    )


def baseline_records(
    panel: DataFrame, keys: list[str], value: str, cut: int, last: int, horizons: tuple[int, ...] = (1, 4),
    models: tuple[str, ...] = ("RW", "MEAN", "ARIMA"),
) -> DataFrame:
    """Records of random walk, expanding mean and AR(1), for targets after ``cut``.

    Only the estimates of the chosen models are computed: the others are pruned from the plan.
    """
    estimates = origin_estimates(panel, keys, value)
    y, forecasts = F.col("_y"), {}
    for h in horizons:
        forecasts["RW", h] = random_walk(y, F.col("_step2"), h)
        forecasts["MEAN", h] = (F.col("_mu"), F.col("_sd"))
        forecasts["ARIMA", h] = ar_one(y, F.col("_slope"), F.col("_icept"), F.col("_var"), h)
    chosen = {k: v for k, v in forecasts.items() if k[0] in models}
    return as_records(estimates, keys, chosen, cut + 1, last)


def direct_predictions(panel: DataFrame, keys: list[str], value: str, h: int) -> DataFrame:
    """Direct h-step regression on the value h periods back: ``period, truth, response, se``.

    The regression behind a prediction for period t ends at t - h, the last target known then.
    """
    w, e = by_period(keys), expanding(keys)
    paired = panel.withColumn("_x", F.lag(value, h).over(w))
    y, x = F.col(value), F.col("_x")
    n = F.regr_count(y, x).over(e)
    fits = paired.select(
        *keys,
        "period",
        value,
        F.when(n >= 3, F.regr_slope(y, x).over(e)).alias("_s"),
        F.when(n >= 3, F.regr_intercept(y, x).over(e)).alias("_i"),
        F.when(n >= 3, F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(y, x).over(e) * (1.0 - F.regr_r2(y, x).over(e)) / n))).alias("_e"),
    )
    return fits.select(
        *keys,
        "period",
        F.col(value).alias("truth"),
        (F.lag("_i", h).over(w) + F.lag("_s", h).over(w) * F.lag(value, h).over(w)).alias("response"),
        F.lag("_e", h).over(w).alias("se"),
    )


def residuals_ar_one(panel: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full-sample AR(1) residuals beside their period; the first row of a series has none."""
    whole = W.partitionBy(*keys)
    paired = panel.withColumn("_x", F.lag(value).over(by_period(keys)))
    y, x = F.col(value), F.col("_x")
    fitted = F.regr_intercept(y, x).over(whole) + F.regr_slope(y, x).over(whole) * x
    return paired.withColumn("residual", y - fitted).filter(F.col("residual").isNotNull()).drop("_x")


