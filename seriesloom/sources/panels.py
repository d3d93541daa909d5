"""From tables and files to the long panel ``keys..., period, measures...``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.periods import parse_quarter
from seriesloom.functions.scalars import clean_name
from seriesloom.session import stage_path


def calendar_panel(df: DataFrame, keys: dict[str, Column], period: Column, measures: dict[str, Column]) -> DataFrame:
    """Aggregate records to one row per key and calendar cell.

    The only step that sees raw records. Its aggregates combine map-side, so a key that holds a
    third of all records still sends at most one row per task and calendar cell; everything after
    it works on series no longer than the calendar.
    """
    named = [c.alias(n) for n, c in keys.items()]
    aggs = [c.alias(n) for n, c in measures.items()]
    return df.groupBy(*named, period.alias("period")).agg(*aggs)


def drop_leading_columns(df: DataFrame, count: int, names: list[str]) -> DataFrame:
    """Drop the first columns of a sheet and name the remaining ones by position."""
    kept = df.columns[count:]
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(kept, names)])


def split_metadata_rows(
    raw: DataFrame, date_col: str = "sasdate", factor_key: str = "factors", code_key: str = "transform"
) -> tuple[DataFrame, DataFrame]:
    """Separate metadata rows from observations in an all-text wide table.

    Metadata rows are recognised by their key, since rows of a distributed read have no position.
    Returns ``(series, factors, code)`` and the typed wide table keyed by ``period``.
    """
    series = [c for c in raw.columns if c != date_col]
    is_meta = F.lower(F.col(date_col)).isin(factor_key, code_key)
    is_meta = is_meta | F.lower(F.col(date_col)).isin(factor_key + ":", code_key + ":")
    meta = (
        raw.filter(is_meta)
        .unpivot([date_col], series, "series", "text")
        .withColumn("kind", F.regexp_replace(F.lower(F.col(date_col)), ":$", ""))
        .groupBy("series")
        .agg(
            F.max(F.when(F.col("kind") == factor_key, F.col("text").try_cast("double"))).cast("int").alias("factors"),
            F.max(F.when(F.col("kind") == code_key, F.col("text").try_cast("double"))).cast("int").alias("code"),
        )
    )
    data = raw.filter(~is_meta).select(
        parse_quarter(F.col(date_col)).alias("period"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in series]
    )
    return meta, data


def read_wide_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Read a wide table as text, so that metadata rows survive until they are split off."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns))


def load_dictionary(df: DataFrame, series: str, group: str, factors: Column) -> DataFrame:
    """Series dictionary with names brought to the panel's spelling."""
    return df.select(
        clean_name(F.col(series)).alias("series"), clean_name(F.col(group)).alias("grp"), factors.cast("int").alias("factors")
    ).distinct()


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and go on from the files: lineage ends here."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
