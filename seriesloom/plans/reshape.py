"""Queries on projection, filters, reshaping and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.periods import quarter_index
from seriesloom.functions.scalars import rounded
from seriesloom.operators import joins, reshape, windows
from seriesloom.plans import bindings as b
from seriesloom.plans.registry import CUT, query, r6, sql
from seriesloom.sources import literals
from seriesloom.sources.panels import calendar_panel


@query(
    "q_project",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem WHERE l_discount > 0.05",
)
def project(spark, d):
    rows = b.table(spark, d, "lineitem").filter(F.col("l_discount") > 0.05)
    return reshape.pick_columns(
        rows, first=["l_orderkey"], matches="^l_(line|quant|ext)", contains="discount", drop=["l_linestatus"]
    )


@query(
    "q_rename",
    "SELECT s_suppkey AS supplier_key, s_name AS SUPPLIER_name, s_nationkey AS SUPPLIER_nationkey, s_acctbal AS SUPPLIER_acctbal FROM supplier",
)
def rename(spark, d):
    return reshape.rename_columns(b.table(spark, d, "supplier"), {0: "supplier_key"}, "^s_", "SUPPLIER_")


@query(
    "q_drop_incomplete",
    f"""WITH p AS (SELECT o_custkey AS series, CAST(year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS INTEGER) AS period,
                          sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)
        SELECT series, period, {r6('value')} AS value FROM p
        WHERE series IN (SELECT series FROM p GROUP BY 1 HAVING min(period) = (SELECT min(period) FROM p))""",
)
def drop_incomplete(spark, d):
    panel = calendar_panel(
        b.table(spark, d, "orders"),
        {"series": F.col("o_custkey")},
        quarter_index(F.col("o_orderdate")),
        {"value": F.sum("o_totalprice")},
    )
    kept = reshape.drop_incomplete(panel, ["series"])
    return kept.select("series", "period", rounded(F.col("value")).alias("value"))


@query(
    "q_period_slice",
    """SELECT o_orderkey, CAST(year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS INTEGER) AS period FROM orders
       WHERE year(o_orderdate)*4 + quarter(o_orderdate) - 1 BETWEEN 7990 AND 7993""",
)
def period_slice(spark, d):
    rows = reshape.date_slice(b.table(spark, d, "orders"), "o_orderdate", 7990, 7993)
    return rows.select("o_orderkey", quarter_index(F.col("o_orderdate")).alias("period"))


@query(
    "q_drop_first_rows",
    sql(
        f"""SELECT entity, period, {r6('value')} AS value FROM (
              SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS r FROM nation_q) WHERE r > 2""",
        "nation_q",
    ),
)
def drop_first_rows(spark, d):
    kept = reshape.drop_first_rows(b.nation_q(spark, d), ["entity"], 2)
    return kept.select("entity", "period", rounded(F.col("value")).alias("value"))


@query(
    "q_membership_filter",
    """SELECT doc_id, lang, source FROM documents
       WHERE lang IN ('en', 'de', 'fr') AND regexp_matches(source, '(?i)^[A-W]') AND NOT regexp_matches(lang, '^d')""",
)
def membership_filter(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.filter(F.col("lang").isin("en", "de", "fr") & F.col("source").rlike("(?i)^[A-W]") & ~F.col("lang").rlike("^d"))


@query(
    "q_train_test_split",
    sql(
        f"""SELECT entity, period, {r6('value')} AS value, CASE WHEN period <= {CUT} THEN 'Training' ELSE 'Test' END AS set_label
            FROM nation_q""",
        "nation_q",
    ),
)
def train_test_split(spark, d):
    return b.nation_q(spark, d).select(
        "entity", "period", rounded(F.col("value")).alias("value"), reshape.split_label(F.col("period"), CUT).alias("set_label")
    )


_MEASURES = ("revenue", "quantity", "discount", "tax")


@query(
    "q_melt",
    sql(
        " UNION ALL ".join(f"SELECT entity, period, '{m}' AS series, {r6(m)} AS value FROM flag_m" for m in _MEASURES),
        "flag_m",
    ),
)
def melt(spark, d):
    wide = b.flag_m(spark, d).drop("n")
    return reshape.melt(wide, ["entity", "period"]).withColumn("value", rounded(F.col("value")))


@query(
    "q_spread_n",
    sql(
        "SELECT period, "
        + ", ".join(
            f"max(CASE WHEN entity = '{f}' THEN {e} END) AS {f}_{m}"
            for f in "ANR"
            for m, e in (("revenue", r6("revenue")), ("n", "n"))
        )
        + " FROM flag_m GROUP BY period",
        "flag_m",
    ),
)
def spread_n(spark, d):
    long = b.flag_m(spark, d).select("entity", "period", rounded(F.col("revenue")).alias("revenue"), "n")
    return reshape.spread(long, ["period"], "entity", reshape.levels(long, "entity"), ["revenue", "n"])


_YEARS = list(range(1995, 2002))


@query(
    "q_transpose",
    "WITH y AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, "
    + ", ".join(f"sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity END) AS {f}" for f in "ANR")
    + " FROM lineitem GROUP BY 1) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS variable, " + ", ".join(f'max(CASE WHEN year = {y} THEN {f} END) AS "{y}"' for y in _YEARS) + " FROM y"
        for f in "ANR"
    ),
)
def transpose(spark, d):
    rows = b.table(spark, d, "lineitem")
    flags = reshape.levels(rows, "l_returnflag")
    per_year = (
        rows.groupBy(F.year("l_shipdate").alias("year"))
        .agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f) for f in flags])
    )
    return reshape.transpose(per_year, "year", reshape.levels(per_year, "year"))


@query(
    "q_complete_cases",
    sql(
        f"SELECT entity, period, {r6('value')} AS value, {r6('y')} AS y FROM growth_q WHERE value IS NOT NULL AND y IS NOT NULL",
        "growth_q",
    ),
)
def complete_cases(spark, d):
    kept = reshape.complete_cases(b.growth_q(spark, d))
    return kept.select("entity", "period", rounded(F.col("value")).alias("value"), rounded(F.col("y")).alias("y"))


@query(
    "q_impute_neighbours",
    sql(
        f"""SELECT entity, period, {r6('coalesce(value, (a + b)/2)')} AS value, value IS NULL AND a + b IS NOT NULL AS imputed FROM (
              SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                     first_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b
              FROM priority_m)""",
        "priority_m",
    ),
)
def impute(spark, d):
    filled = reshape.impute_neighbours(b.priority_m(spark, d), ["entity"])
    return filled.select("entity", "period", rounded(F.col("value")).alias("value"), "imputed")


@query(
    "q_recode",
    """WITH v AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'stationary' ELSE 'non-stationary' END AS adf,
                        CASE WHEN c_nationkey % 2 = 0 THEN 'stationary' ELSE 'non-stationary' END AS kpss FROM customer)
       SELECT c_custkey, CASE adf WHEN 'stationary' THEN 0 ELSE 1 END AS adf, CASE kpss WHEN 'stationary' THEN 0 ELSE 1 END AS kpss,
              CASE adf WHEN 'stationary' THEN 0 ELSE 1 END + CASE kpss WHEN 'stationary' THEN 0 ELSE 1 END AS total FROM v""",
)
def recode(spark, d):
    def verdict(condition):
        return F.when(condition, F.lit("stationary")).otherwise(F.lit("non-stationary"))

    texts = b.table(spark, d, "customer").select(
        "c_custkey", verdict(F.col("c_acctbal") > 0).alias("adf"), verdict(F.col("c_nationkey") % 2 == 0).alias("kpss")
    )
    coded = reshape.recode(texts, ["adf", "kpss"], {"stationary": 0, "non-stationary": 1})
    return coded.withColumn("total", reshape.row_sum(["adf", "kpss"]))


@query(
    "q_nest_unnest",
    sql(
        f"""SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY period) AS INTEGER) AS step, period, {r6('y')} AS y
            FROM growth_q""",
        "growth_q",
    ),
)
def nest_unnest(spark, d):
    nested = reshape.nest(b.growth_q(spark, d).select("entity", "period", rounded(F.col("y")).alias("y")), ["entity"])
    return reshape.unnest(nested, position="step")


@query(
    "q_complete_periods",
    sql(f"SELECT entity, period, {r6('value')} AS value, value IS NOT NULL AS observed FROM priority_m", "priority_m"),
)
def complete_periods(spark, d):
    return b.priority_m(spark, d).select(
        "entity", "period", rounded(F.col("value")).alias("value"), F.col("value").isNotNull().alias("observed")
    )


@query(
    "q_quarter_end",
    sql(
        f"""SELECT entity, CAST(last_day(make_date(period // 12, period % 12 + 1, 1)) AS VARCHAR) AS quarter_end, {r6('value')} AS value,
                   {r6('100.0*(pow(1.0 + (100.0*(pow(value/prev, 4) - 1.0))/100.0, 0.25) - 1.0)')} AS rate
            FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY period) AS prev FROM priority_m)
            WHERE (period + 1) % 3 = 0""",
        "priority_m",
    ),
)
def quarter_end(spark, d):
    rated = b.priority_m(spark, d).withColumn("annual", windows.annualised_growth("value", ["entity"]))
    kept = reshape.quarter_ends(rated)
    return kept.select(
        "entity",
        F.col("quarter_end").cast("string").alias("quarter_end"),
        rounded(F.col("value")).alias("value"),
        rounded(windows.deannualise(F.col("annual"))).alias("rate"),
    )


@query(
    "q_seasonal_frame",
    sql(
        "SELECT entity, CAST(period // 4 AS INTEGER) AS year, "
        + ", ".join(f"max(CASE WHEN period % 4 = {q - 1} THEN {r6('value')} END) AS q{q}" for q in (1, 2, 3, 4))
        + " FROM nation_q GROUP BY 1, 2",
        "nation_q",
    ),
)
def seasonal_frame(spark, d):
    panel = b.nation_q(spark, d).withColumn("value", rounded(F.col("value")))
    return reshape.seasonal_frame(panel, ["entity"])


@query(
    "q_panel_validate",
    """WITH c AS (SELECT o_custkey AS entity, year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS period, count(*) AS n FROM orders GROUP BY 1, 2),
            g AS (SELECT *, period - lag(period) OVER (PARTITION BY entity ORDER BY period) AS step FROM c)
       SELECT entity, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicated,
              CAST(sum(CASE WHEN step > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps
       FROM g GROUP BY entity""",
)
def panel_validate(spark, d):
    keyed = b.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), quarter_index(F.col("o_orderdate")).alias("period"))
    return reshape.validate_panel(keyed, ["entity"])


def _supply(spark, d):
    """Shipped value per supplier nation and quarter, suppliers pre-aggregated before the join."""
    shipped = calendar_panel(
        b.table(spark, d, "lineitem"),
        {"s_suppkey": F.col("l_suppkey")},
        quarter_index(F.col("l_shipdate")),
        {"shipped": F.sum("l_extendedprice")},
    )
    nations = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("entity"))
    suppliers = b.table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(nations, "s_nationkey")
    return shipped.join(suppliers, "s_suppkey").groupBy("entity", "period").agg(F.sum("shipped").alias("shipped"))


_SUPPLY = """supply AS (SELECT n_name AS entity, CAST(year(l_shipdate)*4 + quarter(l_shipdate) - 1 AS INTEGER) AS period,
       sum(l_extendedprice) AS shipped FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


@query(
    "q_left_join_period",
    sql(
        f"""+{_SUPPLY} SELECT entity, period, {r6('value')} AS value, {r6('shipped')} AS shipped
            FROM nation_q LEFT JOIN supply USING (entity, period)""",
        "nation_q",
    ),
)
def left_join_period(spark, d):
    joined = joins.join_on_period(b.nation_q(spark, d), _supply(spark, d), ["entity"])
    return joined.select("entity", "period", rounded(F.col("value")).alias("value"), rounded(F.col("shipped")).alias("shipped"))


@query(
    "q_dictionary_join",
    sql(
        f"SELECT entity, period, {r6('value')} AS value, grp, factors FROM nation_q LEFT JOIN info ON entity = series",
        "nation_q", "info",
    ),
)
def dictionary_join(spark, d):
    joined = joins.dictionary_join(b.nation_q(spark, d), b.info(spark, d), "entity", "series")
    return joined.select("entity", "period", rounded(F.col("value")).alias("value"), "grp", "factors")


@query(
    "q_regime_join",
    sql(
        f"""SELECT entity, period, {r6('y')} AS y, regime_id IS NOT NULL AS in_regime, regime_id
            FROM growth_q LEFT JOIN regimes ON period BETWEEN s AND e""",
        "growth_q", "regimes",
    ),
)
def regime_join(spark, d):
    joined = joins.regime_join(b.growth_q(spark, d), literals.recessions(spark))
    return joined.select("entity", "period", rounded(F.col("y")).alias("y"), "in_regime", "regime_id")


@query(
    "q_zip_join",
    sql(
        f"""SELECT a.entity, a.period, {r6('a.y')} AS target, {r6('b.y')} AS feature
            FROM growth_q a LEFT JOIN growth_q b ON a.entity = b.entity AND a.period - 1 = b.period""",
        "growth_q",
    ),
)
def zip_join(spark, d):
    """Targets beside features of the previous period, bound by key instead of by position."""
    target = b.growth_q(spark, d).select("entity", "period", rounded(F.col("y")).alias("target"))
    feature = b.growth_q(spark, d).select("entity", (F.col("period") + 1).alias("period"), rounded(F.col("y")).alias("feature"))
    return joins.join_on_period(target, feature, ["entity"])


@query(
    "q_semi_anti",
    """SELECT c_custkey, c_mktsegment, 'ordered' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT c_custkey, c_mktsegment, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def semi_anti(spark, d):
    customers = b.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    keys = b.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.members(customers, keys, "c_custkey").withColumn("side", F.lit("ordered")).unionByName(
        joins.members(customers, keys, "c_custkey", keep=False).withColumn("side", F.lit("idle"))
    )


@query(
    "q_origin_cross",
    sql(
        f"""SELECT entity, CAST(o AS INTEGER) AS origin, period, {r6('y')} AS y
            FROM growth_q JOIN (SELECT unnest(range({CUT}, z)) AS o FROM quarters) t ON period <= o WHERE period > (SELECT a FROM quarters)""",
        "growth_q",
    ),
)
def origin_cross(spark, d):
    first, last = b.quarters(spark, d)
    rows = reshape.period_slice(b.growth_q(spark, d), first + 1)
    return joins.origin_rows(rows, CUT, last - 1).select("entity", "origin", "period", rounded(F.col("y")).alias("y"))
