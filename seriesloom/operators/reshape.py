"""Projection, filters and reshaping of panels."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.periods import quarter_bounds, quarter_of, year_of


def by_period(keys: list[str]):
    """Window of one series in time order; a series is never longer than its calendar."""
    return W.partitionBy(*keys).orderBy("period")


def pick_columns(
    df: DataFrame,
    first: Iterable[str] = (),
    contains: str | None = None,
    matches: str | None = None,
    drop: Iterable[str] = (),
    everything: bool = False,
) -> DataFrame:
    """Select columns by name, substring or pattern, in that order, minus ``drop``."""
    chosen = list(first)
    for c in df.columns:
        hit = (contains is not None and contains in c) or (matches is not None and re.search(matches, c)) or everything
        if hit and c not in chosen:
            chosen.append(c)
    gone = set(drop)
    return df.select(*[F.col(f"`{c}`") for c in chosen if c not in gone])


def rename_columns(df: DataFrame, positions: dict[int, str] | None = None, pattern: str | None = None, repl: str = "") -> DataFrame:
    """Rename by position, by pattern, or both."""
    names = {}
    for i, c in enumerate(df.columns):
        new = (positions or {}).get(i, c)
        if pattern and new == c:
            new = re.sub(pattern, repl, c)
        if new != c:
            names[c] = new
    return df.withColumnsRenamed(names)


def drop_incomplete(panel: DataFrame, keys: list[str], value: str = "value", start: int | None = None, names: list | None = None) -> DataFrame:
    """Remove series that start late.

    ``names`` removes a given list; otherwise a series goes when its first observed period lies
    after ``start`` (by default the first period observed anywhere in the panel).
    """
    if names is not None:
        return panel.filter(~F.col(keys[-1]).isin(names))
    seen = F.when(F.col(value).isNotNull(), F.col("period"))
    firsts = panel.withColumn("_first", F.min(seen).over(W.partitionBy(*keys)))
    begin = F.lit(start) if start is not None else panel.agg(F.min(seen).alias("p")).scalar()
    return firsts.withColumn("_start", begin).filter(F.col("_first") <= F.col("_start")).drop("_first", "_start")


def period_slice(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of an inclusive period range; either end may be open."""
    out = df
    if first is not None:
        out = out.filter(F.col("period") >= first)
    if last is not None:
        out = out.filter(F.col("period") <= last)
    return out


def date_slice(df: DataFrame, date_col: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Same range on raw records, as bare date comparisons a Parquet scan can push down."""
    low, high = quarter_bounds(first, last)
    kind = df.schema[date_col].dataType.simpleString()
    out = df
    if low is not None:
        out = out.filter(F.col(date_col) >= F.lit(low).cast(kind))
    if high is not None:
        out = out.filter(F.col(date_col) < F.lit(high).cast(kind))
    return out


def drop_first_rows(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    return df.withColumn("_row", F.row_number().over(by_period(keys))).filter(F.col("_row") > count).drop("_row")


def split_label(period: Column, cut: int) -> Column:
    """Training up to and including ``cut``, Test after it."""
    return F.when(period <= cut, F.lit("Training")).otherwise(F.lit("Test"))


def melt(df: DataFrame, ids: list[str], variable: str = "series", value: str = "value") -> DataFrame:
    return df.unpivot(ids, [c for c in df.columns if c not in ids], variable, value)


def levels(df: DataFrame, column: str) -> list:
    """The distinct values of a column that names columns of a wide table, sorted; NULL names none."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def spread(df: DataFrame, ids: list[str], key: str, levels: list, values: list[str]) -> DataFrame:
    """Long to wide for several value columns at once; columns are named ``level_value``."""
    picked = [
        F.first(F.when(F.col(key) == level, F.col(v)), ignorenulls=True).alias(f"{level}_{v}") for level in levels for v in values
    ]
    return df.groupBy(*ids).agg(*picked)


def transpose(df: DataFrame, id_col: str, levels: list, name: str = "variable") -> DataFrame:
    """Columns become rows; the values of ``id_col`` (known as ``levels``) become columns."""
    long = melt(df, [id_col], name, "_value")
    picked = [F.first(F.when(F.col(id_col) == v, F.col("_value")), ignorenulls=True).alias(str(v)) for v in levels]
    return long.groupBy(name).agg(*picked)


def complete_cases(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=subset)


def complete_periods(panel: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Give every series one row per period of ``[first, last]``; absent values are NULL.

    Each row fills the hole up to its successor, so a single window over the series is enough:
    no calendar join, and later windows on the same keys need no further shuffle.
    """
    values = [c for c in panel.columns if c not in (*keys, "period")]
    w = by_period(keys)
    ranged = period_slice(panel, first, last)
    begin = F.when(F.row_number().over(w) == 1, F.lit(first)).otherwise(F.col("period"))
    end = F.coalesce(F.lead("period").over(w) - 1, F.lit(last))
    spans = ranged.withColumn("_from", begin.cast("int")).withColumn("_to", end.cast("int"))
    slots = spans.withColumn("_slot", F.explode(F.sequence("_from", "_to")))
    return slots.select(
        *keys, F.col("_slot").alias("period"), *[F.when(F.col("_slot") == F.col("period"), F.col(v)).alias(v) for v in values]
    )


def impute_neighbours(panel: DataFrame, keys: list[str], value: str = "value", mode: str = "mean") -> DataFrame:
    """Fill holes inside a series from its last and next observed values.

    ``mode="sequence"`` averages the unit steps from the last value towards the next instead of
    the two values. Leading and trailing holes stay NULL.
    """
    before = F.last(value, ignorenulls=True).over(by_period(keys).rowsBetween(W.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(by_period(keys).rowsBetween(1, W.unboundedFollowing))
    out = panel.withColumn("_a", before).withColumn("_b", after)
    a, b = F.col("_a"), F.col("_b")
    middle = (a + b) / 2 if mode == "mean" else a + F.signum(b - a) * F.floor(F.abs(b - a)) / 2
    filled = F.coalesce(F.col(value), middle)
    return (
        out.withColumn("imputed", F.col(value).isNull() & filled.isNotNull()).withColumn(value, filled).drop("_a", "_b")
    )


def recode(df: DataFrame, columns: list[str], mapping: dict[str, int]) -> DataFrame:
    """Replace text verdicts by numbers."""

    def code(c: str) -> Column:
        out = F.lit(None).cast("int")
        for text, number in mapping.items():
            out = F.when(F.col(c) == text, F.lit(number)).otherwise(out)
        return out

    return df.withColumns({c: code(c) for c in columns})


def row_sum(columns: list[str]) -> Column:
    total: Column = F.lit(0)
    for c in columns:
        total = total + F.col(c)
    return total


def nest(df: DataFrame, keys: list[str], order: str = "period", name: str = "data") -> DataFrame:
    """One row per series holding its observations in order (at most one per calendar cell)."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))


def unnest(df: DataFrame, name: str = "data", position: str | None = None) -> DataFrame:
    keys = [c for c in df.columns if c != name]
    if position is None:
        return df.selectExpr(*keys, f"inline({name})")
    exploded = df.select(*keys, F.posexplode(name).alias("_pos", "_item"))
    return exploded.select(*keys, (F.col("_pos") + 1).cast("int").alias(position), "_item.*")


def quarter_ends(monthly: DataFrame) -> DataFrame:
    """Keep the last month of each quarter, dated at its month end."""
    month = F.pmod(F.col("period"), F.lit(12)) + 1
    first_day = F.make_date(F.floor(F.col("period") / 12).cast("int"), month.cast("int"), F.lit(1))
    return monthly.filter(month % 3 == 0).withColumn("quarter_end", F.last_day(first_day))


def seasonal_frame(panel: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Year rows, quarter columns."""
    tagged = panel.withColumn("year", year_of(F.col("period"))).withColumn("_q", quarter_of(F.col("period")))
    picked = [F.first(F.when(F.col("_q") == q, F.col(value)), ignorenulls=True).alias(f"q{q}") for q in (1, 2, 3, 4)]
    return tagged.groupBy(*keys, "year").agg(*picked)


def validate_panel(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number of rows, of duplicated periods and of gaps between periods.

    Records are counted per cell first, so the window only sees distinct periods.
    """
    cells = df.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("_n"))
    step = F.col("period") - F.lag("period").over(by_period(keys))
    return (
        cells.withColumn("_step", step)
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("n_rows"),
            F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).alias("n_duplicated"),
            F.sum(F.when(F.col("_step") > 1, 1).otherwise(0)).alias("n_gaps"),
        )
    )
