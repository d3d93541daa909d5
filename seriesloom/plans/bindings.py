"""The test tables as panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.periods import day_index, hour_index, month_index, quarter_index
from seriesloom.operators.reshape import complete_periods, date_slice
from seriesloom.operators.windows import growth
from seriesloom.plans.registry import EPOCH
from seriesloom.sources.panels import calendar_panel


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_SPANS: dict[tuple, tuple[int, int]] = {}


def span(spark: SparkSession, d: str, name: str, period: Column) -> tuple[int, int]:
    """First and last calendar cell of a table, both 0 for an empty one: two numbers, read from one column once a session."""
    key = spark.sparkContext.applicationId, d, name, str(period)
    if key not in _SPANS:
        low, high = table(spark, d, name).agg(F.min(period), F.max(period)).first()
        _SPANS[key] = (0, 0) if low is None else (low, high)
    return _SPANS[key]


def quarters(spark: SparkSession, d: str) -> tuple[int, int]:
    return span(spark, d, "orders", quarter_index(F.col("o_orderdate")))


def order_months(spark: SparkSession, d: str) -> tuple[int, int]:
    return span(spark, d, "orders", month_index(F.col("o_orderdate")))


def ship_months(spark: SparkSession, d: str) -> tuple[int, int]:
    return span(spark, d, "lineitem", month_index(F.col("l_shipdate")))


def hours(spark: SparkSession, d: str) -> tuple[int, int]:
    return span(spark, d, "events", hour_index(F.col("ts"), EPOCH))


def nation_raw(spark: SparkSession, d: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Order value per nation and quarter, observed cells only; bounds reach the scan as dates.

    Orders shrink to one row per customer and quarter before they meet the customers, so neither
    the join nor its shuffle sees more than a calendar's worth of rows of any customer.
    """
    per_customer = calendar_panel(
        date_slice(table(spark, d, "orders"), "o_orderdate", first, last),
        {"c_custkey": F.col("o_custkey")},
        quarter_index(F.col("o_orderdate")),
        {"value": F.sum("o_totalprice"), "n_orders": F.count(F.lit(1))},
    )
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey")
    return (
        per_customer.join(customers, "c_custkey")
        .groupBy("entity", "period")
        .agg(F.sum("value").alias("value"), F.sum("n_orders").alias("n_orders"))
    )


def nation_q(spark: SparkSession, d: str) -> DataFrame:
    return complete_periods(nation_raw(spark, d), ["entity"], *quarters(spark, d))


def growth_q(spark: SparkSession, d: str) -> DataFrame:
    return nation_q(spark, d).select("entity", "period", "value", growth("value", ["entity"]).alias("y"))


def codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_name").alias("series"), (F.col("n_nationkey") % 7 + 1).cast("int").alias("code")
    )


def info(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("grp"))
    factors = F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(0)
    return (
        table(spark, d, "nation").join(regions, "n_regionkey").select(F.col("n_name").alias("series"), "grp", factors.alias("factors"))
    )


def priority_raw(spark: SparkSession, d: str) -> DataFrame:
    return calendar_panel(
        table(spark, d, "orders"),
        {"entity": F.col("o_orderpriority")},
        month_index(F.col("o_orderdate")),
        {"value": F.sum("o_totalprice")},
    )


def priority_m(spark: SparkSession, d: str) -> DataFrame:
    return complete_periods(priority_raw(spark, d), ["entity"], *order_months(spark, d))


def flag_m(spark: SparkSession, d: str) -> DataFrame:
    raw = calendar_panel(
        table(spark, d, "lineitem"),
        {"entity": F.col("l_returnflag")},
        month_index(F.col("l_shipdate")),
        {
            "revenue": F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))),
            "quantity": F.avg("l_quantity"),
            "discount": F.avg("l_discount"),
            "tax": F.avg("l_tax"),
            "n": F.count(F.lit(1)),
        },
    )
    return complete_periods(raw, ["entity"], *ship_months(spark, d))


def flag_features(spark: SparkSession, d: str) -> DataFrame:
    """Monthly revenue growth with candidate indicators, as deviations on comparable scales."""
    return flag_m(spark, d).select(
        "entity",
        "period",
        growth("revenue", ["entity"]).alias("y"),
        (F.col("quantity") - 25).alias("q"),
        (F.col("discount") * 100 - 5).alias("disc"),
        (F.col("tax") * 100 - 4).alias("tax"),
        growth("n", ["entity"]).alias("gn"),
    )


FACTOR_FEATURES = ["q", "disc", "tax", "gn", "price", "line", "bulk", "sale"]
# Every second feature belongs to the selective set.
SELECTED_FEATURES = FACTOR_FEATURES[::2]


def factor_panel(spark: SparkSession, d: str) -> DataFrame:
    """Monthly revenue growth per return flag with eight candidate features for factor extraction."""
    raw = calendar_panel(
        table(spark, d, "lineitem"),
        {"entity": F.col("l_returnflag")},
        month_index(F.col("l_shipdate")),
        {
            "revenue": F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))),
            "n": F.count(F.lit(1)),
            "q": F.avg("l_quantity"),
            "disc": F.avg("l_discount") * 100,
            "tax": F.avg("l_tax") * 100,
            "price": F.avg("l_extendedprice") / 1000,
            "line": F.avg("l_linenumber"),
            "bulk": F.avg(F.when(F.col("l_quantity") > 40, 1.0).otherwise(0.0)),
            "sale": F.avg(F.when(F.col("l_discount") > 0.07, 1.0).otherwise(0.0)),
        },
    )
    full = complete_periods(raw, ["entity"], *ship_months(spark, d))
    return full.select(
        "entity", "period", growth("revenue", ["entity"]).alias("y"), growth("n", ["entity"]).alias("gn"),
        "q", "disc", "tax", "price", "line", "bulk", "sale",
    )


def event_h(spark: SparkSession, d: str) -> DataFrame:
    raw = calendar_panel(
        table(spark, d, "events"), {"entity": F.col("event_type")}, hour_index(F.col("ts"), EPOCH), {"n": F.count(F.lit(1))}
    )
    full = complete_periods(raw, ["entity"], *hours(spark, d))
    return full.select("entity", "period", F.coalesce("n", F.lit(0)).cast("double").alias("x"))


def event_d(spark: SparkSession, d: str) -> DataFrame:
    return calendar_panel(
        table(spark, d, "events"), {"entity": F.col("event_type")}, day_index(F.col("ts"), EPOCH), {"x": F.avg("value")}
    )


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Shipments read as a log of tuning trials: three learners, three parameters, one score."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("learner"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trial_id"),
        F.col("l_quantity").alias("trees"),
        F.col("l_discount").alias("rate"),
        F.col("l_tax").alias("cost"),
        (F.col("l_extendedprice") / 1000.0).alias("rmse"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
