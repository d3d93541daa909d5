"""Joins on keys and periods. Positional binding is always a join on (keys, period)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_group_stats(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-group results (one row per key) back to the rows they describe; NULL keys are a group.

    One plan at any number of groups. The results are an aggregate, so adaptive execution knows
    their size before it joins: it broadcasts them while they are below its threshold, and beyond
    that splits the partition of a key that holds very many rows.
    """
    named = stats.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return rows.join(named, same, how).drop(*[f"_on_{k}" for k in keys])


def join_on_period(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Both sides hold one row per series and period, so no key is larger than its calendar."""
    return left.join(right, [*keys, "period"], how)


def dictionary_join(df: DataFrame, dictionary: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join to a dictionary under another key name.

    No hint: Spark broadcasts the dictionary while its estimated size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides beyond it.
    """
    renamed = dictionary.withColumnRenamed(right_key, left_key)
    return df.join(renamed, left_key, "left")


def regime_periods(regimes: DataFrame) -> DataFrame:
    """Closed intervals as one row per period; overlapping intervals keep the earliest id."""
    return (
        regimes.select("regime_id", F.explode(F.sequence("start", "end")).alias("period"))
        .groupBy("period")
        .agg(F.min("regime_id").alias("regime_id"))
    )


def regime_join(df: DataFrame, regimes: DataFrame, period: str = "period") -> DataFrame:
    """Flag rows whose period lies inside a regime.

    Periods are integers, so the range condition becomes an equality on expanded intervals:
    a hash join at any number of regimes, never a nested loop.
    """
    marks = regime_periods(regimes).withColumnRenamed("period", period)
    return df.join(marks, period, "left").withColumn("in_regime", F.col("regime_id").isNotNull())


def members(df: DataFrame, keys: DataFrame, on: str, keep: bool = True) -> DataFrame:
    """Rows whose key is (not) in ``keys``; the key side is made distinct first, map-side."""
    return df.join(keys.select(on).distinct(), on, "left_semi" if keep else "left_anti")


def origin_rows(panel: DataFrame, first_origin: int, last_origin: int) -> DataFrame:
    """Expanding training sets: each row once per origin at or after its period.

    A row knows its own origins, so they are generated in place instead of matched by a theta
    join. Only for models that need raw rows; linear models use expanding moments.
    """
    start = F.greatest(F.col("period"), F.lit(first_origin))
    span = F.when(start <= last_origin, F.sequence(start, F.lit(last_origin)))
    return panel.withColumn("origin", F.explode(span))
