"""Orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def arrange(df: DataFrame, *columns) -> DataFrame:
    return df.orderBy(*columns)


def custom_order(df: DataFrame, order: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Sort by the position of a key in a given list; absent keys come last."""
    return df.join(order, key, "left").orderBy(F.col(pos).asc_nulls_last(), key)


def order_within(groups: DataFrame, facet: str, value: str, tie: str, name: str = "pos") -> DataFrame:
    """Position inside each facet of a summarised table (one row per facet and group)."""
    return groups.withColumn(name, F.row_number().over(W.partitionBy(facet).orderBy(value, tie)))


def bind_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def common_keys(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys are made distinct before they meet, so a frequent key crosses the shuffle once per task."""
    return left.select(on).distinct().intersect(right.select(on).distinct())


def mismatch_report(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys present on one side only, with the side that lacks them."""
    a, b = left.select(on).distinct(), right.select(on).distinct()
    return a.join(b, on, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(
        b.join(a, on, "left_anti").withColumn("missing_in", F.lit("left"))
    )


def minus_keys(left: DataFrame, *others: DataFrame) -> DataFrame:
    gone = others[0]
    for o in others[1:]:
        gone = gone.unionByName(o)
    return left.distinct().subtract(gone.distinct())
