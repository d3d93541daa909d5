"""Aggregations, including exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.scalars import cut, ratio
from seriesloom.operators.joins import attach_group_stats


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 100_000) -> DataFrame:
    """Exact linear-interpolated percentiles of groups that may hold most of the table.

    The built-in exact percentile gathers a group's distinct values in one aggregation buffer.
    Here a mergeable sketch first brackets each wanted rank within ``4 / accuracy`` of the group.
    A second grouped count keeps apart only the values inside a bracket and lumps the others, so
    no task receives more than that slice of any group. The lump also keeps the values next to each
    bracket: in a small group, where the sketch is exact, a rank may lie one place outside.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 4.0 / accuracy
    lows = F.percentile_approx("_v", [max(0.0, p - margin) for p in probs.values()], accuracy)
    highs = F.percentile_approx("_v", [min(1.0, p + margin) for p in probs.values()], accuracy)
    brackets = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), lows.alias("_lo"), highs.alias("_hi"))
    joined = attach_group_stats(rows, brackets, keys)
    v, inside = F.col("_v"), F.lit(False)
    for i in range(len(probs)):
        inside = inside | ((v >= F.col("_lo")[i]) & (v <= F.col("_hi")[i]))
    counted = joined.groupBy(*keys, F.when(inside, v).alias("_v"), "_n", "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("_c"),
        F.array(*[F.count(F.when(v < F.col("_lo")[i], 1)) for i in range(len(probs))]).alias("_below"),
        F.array(*[F.max(F.when(v < F.col("_lo")[i], v)) for i in range(len(probs))]).alias("_before"),
        F.array(*[F.min(F.when(v > F.col("_hi")[i], v)) for i in range(len(probs))]).alias("_after"),
    )
    wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
    carried = ["_v", "_n", "_c", "_lo", "_hi", "_below", "_before", "_after"]
    slots = counted.select(*keys, *carried, F.posexplode(wanted).alias("_i", "_p"))
    group = W.partitionBy(*keys, "_i")
    low, high = F.col("_lo")[F.col("_i")], F.col("_hi")[F.col("_i")]
    hit = (v >= low) & (v <= high)
    running = F.sum(F.when(hit, F.col("_c"))).over(group.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    below = F.sum(F.col("_below")[F.col("_i")]).over(group)
    ranked = slots.withColumns(
        {
            "_under": below,
            "_upto": below + running,
            "_prev": F.max(F.col("_before")[F.col("_i")]).over(group),
            "_next": F.min(F.col("_after")[F.col("_i")]).over(group),
        }
    ).filter(hit)
    place = F.col("_p") * (F.col("_n") - 1)

    def at(rank: Column) -> Column:
        found = F.min(F.when(F.col("_upto") >= rank, v))
        return F.when(F.max(rank <= F.col("_under")), F.max("_prev")).otherwise(F.coalesce(found, F.min("_next")))

    picked = ranked.groupBy(*keys, "_i").agg(
        at(F.floor(place) + 1).alias("_x"), at(F.ceil(place) + 1).alias("_y"), F.max(place - F.floor(place)).alias("_f")
    )
    result = F.col("_x") + F.col("_f") * (F.col("_y") - F.col("_x"))
    columns = [F.max(F.when(F.col("_i") == i, result)).alias(name) for i, name in enumerate(probs)]
    return picked.groupBy(*keys).agg(*columns)


def exact_percentiles_of(df: DataFrame, keys: list[str], columns: list[str], probs: dict[str, float], accuracy: int = 100_000) -> DataFrame:
    """Percentiles of several columns in the same passes; results are named ``column_prob``."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "_name", "_value")
    tall = exact_percentiles(long, [*keys, "_name"], "_value", probs, accuracy)
    cells = [F.max(F.when(F.col("_name") == c, F.col(p))).alias(f"{c}_{p}") for c in columns for p in probs]
    return tall.groupBy(*keys).agg(*cells)


def group_counts(df: DataFrame, facet: str, group: str, order: str) -> DataFrame:
    """Group sizes with their running total, groups in order of first appearance.

    The running total is over groups of one facet, not over rows.
    """
    counts = df.groupBy(facet, group).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = W.partitionBy(facet).orderBy("_first", group).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("cum_n", F.sum("n").over(w)).drop("_first")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def binned_means(df: DataFrame, x: str, x_breaks: list[float], y: str, y_breaks: list[float], value: str) -> DataFrame:
    """Mean of ``value`` per cell of two binned columns (right-closed bins)."""
    return (
        df.withColumn("bin_x", cut(F.col(x), x_breaks))
        .withColumn("bin_y", cut(F.col(y), y_breaks))
        .groupBy("bin_x", "bin_y")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    )


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def univariate_r2(long: DataFrame, keys: list[str], target: str, value: str) -> DataFrame:
    return long.groupBy(*keys).agg(F.regr_r2(target, value).alias("r2"), F.count(value).alias("n"))


def histogram_density(df: DataFrame, keys: list[str], value: str, low: float, width: float) -> DataFrame:
    """Histogram on density scale with the parameters of the matching normal curve.

    Both results come from partial aggregates: cells first, then their totals per key.
    """
    cell = F.floor((F.col(value) - low) / width).cast("int")
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    curve = df.groupBy(*keys).agg(
        F.count(value).alias("_total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    return (
        attach_group_stats(cells, curve, keys)
        .withColumn("density", F.col("n") / (F.col("_total") * F.lit(float(width))))
        .drop("_total")
    )


def accuracy_suite(df: DataFrame, keys: list[str], actual: str, forecast: str, role: str = "role", train: str = "Training") -> DataFrame:
    """Accuracy of a long forecast: ME, RMSE, MAE, MPE, MAPE, MASE and lag-one error autocorrelation.

    ``df`` holds training and test rows of each series; the MASE scale is the mean absolute first
    difference of the training part.
    """
    w = W.partitionBy(*keys).orderBy("period")
    is_train = F.col(role) == train
    error = F.when(~is_train, F.col(actual) - F.col(forecast))
    step = F.when(is_train, F.abs(F.col(actual) - F.lag(actual).over(w)))
    tagged = df.withColumn("_e", error).withColumn("_step", step)
    centred = tagged.withColumn("_d", F.col("_e") - F.avg("_e").over(W.partitionBy(*keys)))
    lagged = centred.withColumn("_dd", F.col("_d") * F.lag("_d").over(w))
    relative = ratio(F.col("_e"), F.col(actual))
    return lagged.groupBy(*keys).agg(
        F.count("_e").alias("n"),
        F.avg("_e").alias("me"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(F.abs("_e")).alias("mae"),
        F.avg(100 * relative).alias("mpe"),
        F.avg(F.abs(100 * relative)).alias("mape"),
        ratio(F.avg(F.abs("_e")), F.avg("_step")).alias("mase"),
        ratio(F.sum("_dd"), F.sum(F.col("_d") * F.col("_d"))).alias("acf1"),
    )
