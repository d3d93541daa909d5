"""Transformation of series to stationarity by transformation code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import ratio, safe_log
from seriesloom.operators.reshape import by_period, drop_first_rows


def override_codes(codes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace the code of the listed series."""
    new = overrides.withColumnRenamed("code", "_new")
    return codes.join(new, "series", "left").withColumn("code", F.coalesce("_new", "code").cast("int")).drop("_new")


def transform_by_code(value: str, code: Column, keys: list[str], scale: float = 100.0) -> Column:
    """Codes: 2 first and 3 second difference, 4 log, 5 and 6 first and second log difference,
    7 difference of growth, anything else the level. ``scale`` applies to 5, 6 and 7."""
    w = by_period(keys)
    x = F.col(value)
    x1, x2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    y, y1, y2 = safe_log(x), safe_log(x1), safe_log(x2)
    change = (ratio(x, x1) - 1.0) - (ratio(x1, x2) - 1.0)
    return (
        F.when(code == 2, x - x1)
        .when(code == 3, x - 2.0 * x1 + x2)
        .when(code == 4, y)
        .when(code == 5, (y - y1) * scale)
        .when(code == 6, (y - 2.0 * y1 + y2) * scale)
        .when(code == 7, change * scale)
        .otherwise(x)
    )


def make_stationary(
    panel: DataFrame, codes: DataFrame, keys: list[str], series: str, value: str = "value", percent: bool = True
) -> DataFrame:
    """Transform every series that has a code; series without one are left out (inner join).

    Both lags share one window, so the panel is shuffled once for all codes.
    """
    coded = panel.join(codes.withColumnRenamed("series", series), series, "inner")
    moved = transform_by_code(value, F.col("code"), keys, 100.0 if percent else 1.0)
    return coded.withColumn("stationary", moved)


def stationary_panel(panel: DataFrame, codes: DataFrame, keys: list[str], series: str, value: str = "value") -> DataFrame:
    """Transformed values beside the levels, without the two periods lost to differencing.

    The level travels through the transformation, so no join back to the panel is needed.
    """
    return drop_first_rows(make_stationary(panel, codes, keys, series, value), keys, 2)
