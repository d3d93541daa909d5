"""Queries on reading, splitting, looking up and staging tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.periods import format_quarter, parse_quarter, quarter_index, quarter_of, year_of
from seriesloom.functions.scalars import clean_name, rounded
from seriesloom.operators.joins import regime_join
from seriesloom.operators.ordering import bind_rows
from seriesloom.operators.reshape import levels, melt
from seriesloom.operators.stationary import override_codes
from seriesloom.plans import bindings as b
from seriesloom.plans.registry import query, r6, sql
from seriesloom.session import stage_path
from seriesloom.sources import literals
from seriesloom.sources.panels import load_dictionary, read_wide_csv, split_metadata_rows, stage


@query(
    "q_load_panel",
    sql(f"SELECT entity, 'TOTALPRICE' AS series, period, {r6('value')} AS value, n_orders FROM nation_raw", "nation_raw"),
)
def load_panel(spark, d):
    return b.nation_raw(spark, d).select(
        "entity", F.lit("TOTALPRICE").alias("series"), "period", rounded(F.col("value")).alias("value"), "n_orders"
    )


@query(
    "q_split_metadata_rows",
    sql(
        f"""
        SELECT 'factors' AS kind, series, CAST(NULL AS INTEGER) AS period, CAST(factors AS DOUBLE) AS value FROM info
        UNION ALL SELECT 'code', series, NULL, CAST(code AS DOUBLE) FROM codes
        UNION ALL SELECT 'data', entity, period, {r6('value')} FROM nation_q""",
        "info", "codes", "nation_q",
    ),
)
def split_rows(spark, d):
    """The wide feature file is rebuilt from the panel as CSV, read as text and taken apart."""
    panel, info, codes = b.nation_q(spark, d), b.info(spark, d), b.codes(spark, d)
    names = levels(codes, "series")

    def wide(long, key, value):
        cells = [F.first(F.when(F.col(key[0]) == n, value), ignorenulls=True).alias(n) for n in names]
        return long.groupBy(key[1]).agg(*cells)

    first_day = F.concat_ws("/", ((quarter_of(F.col("period")) - 1) * 3 + 1).cast("string"), F.lit("1"), year_of(F.col("period")).cast("string"))
    body = wide(panel.withColumn("sasdate", first_day), ("entity", "sasdate"), F.col("value").cast("string"))
    factors = wide(info.withColumn("sasdate", F.lit("factors")), ("series", "sasdate"), F.col("factors").cast("string"))
    transform = wide(codes.withColumn("sasdate", F.lit("transform:")), ("series", "sasdate"), F.col("code").cast("string"))
    path = stage_path(spark, "wide-file")
    bind_rows(factors, transform, body).select("sasdate", *names).write.csv(path, header=True)
    meta, data = split_metadata_rows(read_wide_csv(spark, path, ["sasdate", *names]))
    no_period = F.lit(None).cast("int").alias("period")
    return bind_rows(
        meta.unpivot(["series"], ["factors", "code"], "kind", "value").select(
            "kind", "series", no_period, F.col("value").cast("double").alias("value")
        ),
        melt(data, ["period"]).select(F.lit("data").alias("kind"), "series", "period", rounded(F.col("value")).alias("value")),
    )


@query(
    "q_inline_calendar",
    sql(
        """
        SELECT CAST(year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS INTEGER) AS period, regime_id, count(*) AS n_orders
        FROM orders LEFT JOIN regimes
          ON year(o_orderdate)*4 + quarter(o_orderdate) - 1 BETWEEN s AND e
        GROUP BY 1, 2""",
        "regimes",
    ),
)
def inline_calendar(spark, d):
    counts = b.table(spark, d, "orders").groupBy(quarter_index(F.col("o_orderdate")).alias("period")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    return regime_join(counts, literals.recessions(spark)).select("period", "regime_id", "n_orders")


_CLEAN = (
    "upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({0}, '%', '_percent_'), '#', '_number_'),"
    " '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
)


@query(
    "q_load_dictionary",
    f"""SELECT DISTINCT {_CLEAN.format('p_name')} AS series, {_CLEAN.format('p_brand')} AS grp,
               CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS factors FROM part""",
)
def dictionary(spark, d):
    even = F.when(F.col("p_size") % 2 == 0, 1).otherwise(0)
    return load_dictionary(b.table(spark, d, "part"), "p_name", "p_brand", even)


@query(
    "q_stage_roundtrip",
    sql(
        f"""SELECT entity AS model_id, period, {r6('revenue')} AS revenue, n, month AS month_of_year FROM (
              SELECT *, CAST(period % 12 + 1 AS INTEGER) AS month FROM flag_m)""",
        "flag_m",
    ),
)
def stage_roundtrip(spark, d):
    """Written partitioned by model and read back with the declared schema."""
    panel = b.flag_m(spark, d).select(
        F.col("entity").alias("model_id"),
        "period",
        rounded(F.col("revenue")).alias("revenue"),
        "n",
        (F.col("period") % 12 + 1).cast("int").alias("month_of_year"),
    )
    return stage(panel, "forecast-stage", ["model_id"])


@query(
    "q_clean_names",
    f"""SELECT p_brand AS raw, {_CLEAN.format('p_brand')} AS cleaned, count(*) AS n FROM part GROUP BY 1, 2
        UNION ALL SELECT s_name || 'x', {_CLEAN.format("s_name || 'x'")}, count(*) FROM supplier GROUP BY 1, 2
        UNION ALL SELECT upper(p_type) || 'x', {_CLEAN.format("upper(p_type) || 'x'")}, count(*) FROM part GROUP BY 1, 2
        UNION ALL SELECT source || '%' || lang, {_CLEAN.format("source || '%' || lang")}, count(*) FROM documents GROUP BY 1, 2""",
)
def clean_names(spark, d):
    part, docs = b.table(spark, d, "part"), b.table(spark, d, "documents")
    raw = bind_rows(
        part.select(F.col("p_brand").alias("raw")),
        b.table(spark, d, "supplier").select(F.concat("s_name", F.lit("x")).alias("raw")),
        part.select(F.concat(F.upper("p_type"), F.lit("x")).alias("raw")),
        docs.select(F.concat("source", F.lit("%"), "lang").alias("raw")),
    )
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).withColumn("cleaned", clean_name(F.col("raw")))


@query(
    "q_tcode_override",
    """SELECT p_brand AS series, CAST(CASE p_brand WHEN 'Brand#2' THEN 2 WHEN 'Brand#7' THEN 5 ELSE max(p_size) % 7 + 1 END AS INTEGER) AS code
       FROM part GROUP BY p_brand""",
)
def tcode_override(spark, d):
    published = b.table(spark, d, "part").groupBy(F.col("p_brand").alias("series")).agg((F.max("p_size") % 7 + 1).cast("int").alias("code"))
    overrides = literals.literal_table(spark, [("Brand#2", 2), ("Brand#7", 5)], "series string, code int")
    return override_codes(published, overrides)


@query(
    "q_period_codec",
    """SELECT q AS period, text, shown, count(*) AS n FROM (
         SELECT CAST(year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS INTEGER) AS q,
                CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate)
                                    WHEN 1 THEN year(o_orderdate) || ' Q' || quarter(o_orderdate)
                                    ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS text,
                year(o_orderdate) || ' Q' || quarter(o_orderdate) AS shown FROM orders)
       GROUP BY 1, 2, 3""",
)
def period_codec(spark, d):
    day = F.col("o_orderdate")
    year, part = F.year(day).cast("string"), F.quarter(day).cast("string")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(year, F.lit("Q"), part))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(year, F.lit(" Q"), part))
        .otherwise(F.concat_ws("/", F.month(day).cast("string"), F.day(day).cast("string"), year))
    )
    counts = b.table(spark, d, "orders").groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    period = parse_quarter(F.col("text"))
    return counts.select(period.alias("period"), "text", format_quarter(period).alias("shown"), "n")
