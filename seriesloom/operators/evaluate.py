"""From forecast records to accuracy, relative accuracy and predictive-accuracy tests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.scalars import cut_label, percent_text, ratio
from seriesloom.operators.aggregates import exact_percentiles_of
from seriesloom.operators.baselines import RECORD_COLUMNS
from seriesloom.operators.joins import attach_group_stats
from seriesloom.operators.moments import map_rows


def ml_records(
    predictions: DataFrame, keys: list[str], model_id: str, h: int, horizon: str, with_band: bool = True
) -> DataFrame:
    """Learner predictions (``period, truth, response[, se]``) as forecast records.

    Bands are one standard error wide, or NULL where the learner gives none.
    """
    se = F.col("se").cast("double") if with_band and "se" in predictions.columns else F.lit(None).cast("double")
    return predictions.select(
        *keys,
        F.lit(model_id).alias("model_id"),
        F.lit(horizon).alias("horizon"),
        (F.col("period") - h).cast("int").alias("training_end"),
        F.lit(h).alias("periods_ahead"),
        F.col("period").alias("forecast_period"),
        F.col("truth").alias("true_value"),
        F.col("response").alias("mean"),
        (F.col("response") - se).alias("lower"),
        (F.col("response") + se).alias("upper"),
        (F.col("truth") - F.col("response")).alias("error"),
        F.lit("direct").alias("strategy"),
        F.when(se.isNull(), F.lit(None).cast("string")).otherwise(F.lit("1se")).alias("band_kind"),
    ).select(*keys, *RECORD_COLUMNS)


def relative_errors(records: DataFrame, keys: list[str], benchmark: str) -> DataFrame:
    """Error over the benchmark's error for the same target; NULL where that is zero or absent.

    Partitions hold one row per model, so the benchmark is found in place without a join.
    """
    cell = W.partitionBy(*keys, "horizon", "forecast_period")
    base = F.max(F.when(F.col("model_id") == F.concat(F.lit(benchmark + "_"), F.col("horizon")), F.col("error"))).over(cell)
    return records.withColumn("rel_error", ratio(F.col("error"), base))


def error_metrics(records: DataFrame, by: list[str], bounded: bool = False) -> DataFrame:
    """MSE, RMSE, MAE, ME, and medians of absolute and relative absolute errors.

    ``bounded`` groups (one series each) take the built-in median; pooled groups take the
    bracketed one, whose tasks stay small however many series a model has.
    """
    e = F.col("error")
    sums = [
        F.count(e).alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("me"),
    ]
    if bounded:
        medians = [F.median(F.abs(e)).alias("mdae"), F.median(F.abs("rel_error")).alias("mdrae")]
        return records.groupBy(*by).agg(*sums, *medians)
    tagged = records.select(*by, "error", F.abs(e).alias("mdae"), F.abs("rel_error").alias("mdrae"))
    medians = exact_percentiles_of(tagged, by, ["mdae", "mdrae"], {"q": 0.5})
    medians = medians.withColumnsRenamed({"mdae_q": "mdae", "mdrae_q": "mdrae"})
    return attach_group_stats(tagged.groupBy(*by).agg(*sums), medians, by, "left")


def sign_hits(records: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    """Number of targets in a period range and of forecasts with the right sign (zero matches zero)."""
    right = F.when(F.signum("true_value") == F.signum("mean"), 1).otherwise(0)
    return (
        records.filter(F.col("forecast_period").between(first, last))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_periods"), F.sum(right).alias("right_sign"))
    )


def loss_differences(records: DataFrame, keys: list[str], pairs: list[tuple[str, str]], power: int) -> DataFrame:
    """Loss of the benchmark minus loss of the model, per target, for literal (model, benchmark) pairs.

    Errors of one target are gathered in a map with one entry per model; the listed pairs are read
    from it. Rows where either side is missing drop out.
    """
    errors = records.filter(F.col("error").isNotNull()).groupBy(*keys, "horizon", "periods_ahead", "forecast_period").agg(
        F.map_from_entries(F.collect_list(F.struct("model_id", "error"))).alias("_errors")
    )
    listed = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(b).alias("benchmark")) for m, b in pairs]
    )
    rows = errors.withColumn("_pair", F.explode(listed)).select(
        *keys, "horizon", "periods_ahead", "forecast_period", "_pair.*", "_errors"
    )

    def loss(name: str) -> Column:
        full = F.concat(F.col(name), F.lit("_"), F.col("horizon"))
        return F.pow(F.abs(F.try_element_at("_errors", full)), F.lit(float(power)))

    return rows.withColumn("d", loss("benchmark") - loss("model")).filter(F.col("d").isNotNull()).drop("_errors")


def dm_statistic(
    records: DataFrame, keys: list[str], pairs: list[tuple[str, str]], power: int = 2, adjusted: bool = True, max_h: int = 4
) -> DataFrame:
    """Diebold-Mariano statistic per series, horizon and pair; large values favour the model.

    The long-run variance takes h - 1 autocovariances. With n <= h targets these are all there are
    and their weighted sum is zero by construction, so the statistic is NULL; so it is for any
    variance that is not positive. ``adjusted`` applies the small-sample factor.
    """
    by = [*keys, "horizon", "periods_ahead", "model", "benchmark"]
    w = W.partitionBy(*by).orderBy("forecast_period")
    d = loss_differences(records, keys, pairs, power)
    centred = d.withColumn("_c", F.col("d") - F.avg("d").over(W.partitionBy(*by)))
    lags = {f"_g{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, max_h)}
    sums = centred.withColumns(lags).groupBy(*by).agg(
        F.count("d").alias("n"),
        F.avg("d").alias("mean_d"),
        F.sum(F.col("_c") * F.col("_c")).alias("_s0"),
        *[F.sum(f"_g{k}").alias(f"_s{k}") for k in range(1, max_h)],
    )
    n, h = F.col("n"), F.col("periods_ahead")
    tail = [F.when(h > k, F.coalesce(F.col(f"_s{k}"), F.lit(0.0))).otherwise(F.lit(0.0)) for k in range(1, max_h)]
    variance = ratio(F.col("_s0") + 2.0 * reduce(lambda a, b: a + b, tail), n * n)
    usable = (variance > 0) & (n > h)
    raw = F.when(usable, F.col("mean_d") / F.sqrt(F.when(usable, variance)))
    inner = (n + 1 - 2 * h + h * (h - 1) / n) / n
    factor = F.when(inner > 0, F.sqrt(F.when(inner > 0, inner))) if adjusted else F.lit(1.0)
    return sums.select(*by, "n", "mean_d", (raw * factor).alias("statistic"))


def model_name(model_id: str = "model_id") -> Column:
    """Model without its horizon and information set."""
    return F.regexp_replace(model_id, "_[QY](_I[0-9]+)?$", "")


def all_comparisons(
    records: DataFrame, keys: list[str], models: list[str], pairs: list[tuple[str, str]] | None = None, power: int = 2, adjusted: bool = True
) -> DataFrame:
    """Diebold-Mariano statistics of all ``(model, benchmark)`` pairs of ``models``, or those listed, from one pass.

    The targets that every model has forecast give one vector of losses each. A series' vectors, no more
    than its calendar is long, yield the means and the products of losses k periods apart, a models x models matrix per
    lag up to h - 1. A pair's mean difference is a difference of means, and each of its autocovariances is a
    quadratic form of one of these matrices, so no pair needs its own join or window. Statistics are NULL as
    in ``dm_statistic``; series without a common target give no row.
    """
    pairs = pairs or [(m, b) for m in models for b in models if m != b]
    m, bench = ([models.index(p[i]) for p in pairs] for i in (0, 1))
    by = [*keys, "horizon", "periods_ahead"]
    errors = records.filter(F.col("error").isNotNull()).groupBy(*by, "forecast_period").agg(
        F.map_from_entries(F.collect_list(F.struct(model_name().alias("model"), "error"))).alias("_errors")
    )
    losses = F.array(*[F.pow(F.abs(F.try_element_at("_errors", F.lit(name))), F.lit(float(power))) for name in models])
    whole = errors.withColumn("_l", losses).filter(~F.exists("_l", lambda v: v.isNull()))
    series = whole.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("forecast_period").alias("t"), F.col("_l").alias("l")))).alias("_d"))
    series = series.select(*by, F.transform("_d", lambda v: v["t"]).alias("_t"), F.flatten(F.transform("_d", lambda v: v["l"])).alias("_l"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in pdf.itertuples(index=False):
            t = np.asarray(row[-2], dtype=int)
            loss = np.asarray(row[-1], dtype=float).reshape(len(t), len(models))
            n, h = len(t), int(row[len(by) - 1])
            mean = loss.mean(0)
            centred = np.zeros((t[-1] - t[0] + 1, len(models)))  # a target that is not there adds nothing
            centred[t - t[0]] = loss - mean
            total = np.zeros(len(pairs))
            for k in range(min(h, len(centred))):
                c = centred[k:].T @ centred[: len(centred) - k]
                total += (1 if k == 0 else 2) * (c[bench, bench] - c[bench, m] - c[m, bench] + c[m, m])
            variance, apart = total / n**2, mean[bench] - mean[m]
            with np.errstate(all="ignore"):
                stat = np.where((variance > 0) & (n > h), apart / np.sqrt(variance), np.nan)
            inner = (n + 1 - 2 * h + h * (h - 1) / n) / n
            stat = stat * (np.sqrt(inner) if inner > 0 else np.nan) if adjusted else stat
            out = pd.DataFrame({"model": [p[0] for p in pairs], "benchmark": [p[1] for p in pairs], "n": n, "mean_d": apart, "statistic": stat})
            for key, value in zip(by, row):
                out[key] = value
            parts.append(out[[*by, "model", "benchmark", "n", "mean_d", "statistic"]])
        return pd.concat(parts)

    schema = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in by)
    made = map_rows(series, run, f"{schema}, model string, benchmark string, n bigint, mean_d double, statistic double")
    return made.withColumn("statistic", F.when(~F.isnan("statistic"), F.col("statistic")))


# Edges of the p-value classes, closed on the left.
P_VALUE_BREAKS = [float("-inf"), 0.01, 0.05, 0.1, 1.0]


def heatmap_rows(tests: DataFrame, gains: DataFrame, on: list[str]) -> DataFrame:
    """P-value class beside the accuracy gain, its direction and its text."""
    gain = F.round("gain", 2)
    return tests.join(gains, on, "left").select(
        *on,
        "p_value",
        cut_label(F.col("p_value"), P_VALUE_BREAKS, right=False).alias("p_range"),
        F.when(gain > 0, F.lit("Increase")).when(gain.isNotNull(), F.lit("Worsening")).alias("direction"),
        percent_text(gain).alias("gain_text"),
    )


def pair_gains(metrics: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """1 - RMSE(model) / RMSE(benchmark) for the listed pairs, per horizon, from metric rows."""
    cells = metrics.groupBy(*keys, "horizon").agg(F.map_from_entries(F.collect_list(F.struct("model_id", "rmse"))).alias("_m"))
    listed = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(b).alias("benchmark")) for m, b in pairs])
    rows = cells.withColumn("_pair", F.explode(listed)).select(*keys, "horizon", "_pair.*", "_m")

    def rmse(name: str) -> Column:
        return F.try_element_at("_m", F.concat(F.col(name), F.lit("_"), F.col("horizon")))

    return rows.withColumn("gain", 1.0 - ratio(rmse("model"), rmse("benchmark"))).drop("_m")


def accuracy_table(records: DataFrame, keys: list[str], benchmark: str, order: DataFrame) -> DataFrame:
    """RMSE, MdRAE and RMSE relative to the benchmark, quarter and year side by side, in list order."""
    metrics = error_metrics(relative_errors(records, keys, benchmark), ["model_id", "horizon"])
    wide = (
        metrics.withColumn("model", model_name())
        .groupBy("model")
        .agg(
            *[
                F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_{h.lower()}")
                for h in ("Q", "Y")
                for c in ("rmse", "mdrae")
            ]
        )
    )
    bench = {
        h: wide.filter(F.col("model") == benchmark).agg(F.max(f"rmse_{h}").alias("r")).scalar() for h in ("q", "y")
    }
    rated = wide.withColumns({"_bq": bench["q"], "_by": bench["y"]})
    rated = rated.withColumns({f"relrmse_{h}": ratio(F.col(f"rmse_{h}"), F.col(f"_b{h}")) for h in ("q", "y")})
    return rated.drop("_bq", "_by").join(order.withColumnRenamed("model_id", "model"), "model", "left").orderBy("pos")


def blank_bands(records: DataFrame, models: list[str]) -> DataFrame:
    hidden = F.col("model_id").isin(models)
    return records.withColumns({c: F.when(~hidden, F.col(c)) for c in ("lower", "upper")})
