"""Queries on scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.periods import quarter_index, quarter_start
from seriesloom.functions.scalars import band, chi2_tail_even, normal_quantile, percent_text, ratio, rounded, safe_log, stars
from seriesloom.functions.tails import chi2_sf, f_sf, normal_sf, t_sf
from seriesloom.plans import bindings as b
from seriesloom.plans import sqltools as st
from seriesloom.plans.registry import query, r6


@query(
    "q_concat",
    """SELECT c_custkey, c_mktsegment || '_Q' AS suffixed, 'SEG.' || c_mktsegment AS prefixed,
              concat_ws('_', c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name) AS united FROM customer""",
)
def concat(spark, d):
    return b.table(spark, d, "customer").select(
        "c_custkey",
        F.concat("c_mktsegment", F.lit("_Q")).alias("suffixed"),
        F.concat(F.lit("SEG."), "c_mktsegment").alias("prefixed"),
        F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string"), "c_name").alias("united"),
    )


@query(
    "q_regex",
    """SELECT doc_id, md5(regexp_replace(text, '_', '\\\\_', 'g')) AS escaped, regexp_matches(text, '(?i)the') AS has_the,
              regexp_extract(text, '[0-9]+', 0) AS first_number FROM documents""",
)
def regex(spark, d):
    """Whole texts go through the expressions; a digest keeps the compared result small."""
    return b.table(spark, d, "documents").select(
        "doc_id",
        F.md5(F.regexp_replace("text", "_", r"\\_")).alias("escaped"),
        F.col("text").rlike("(?i)the").alias("has_the"),
        F.regexp_extract("text", "[0-9]+", 0).alias("first_number"),
    )


@query(
    "q_format",
    """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS thousands, CAST(CAST(round(o_totalprice/1000) AS BIGINT) AS VARCHAR) AS plain,
              CAST(round(o_orderkey % 1000/1000.0*100) AS BIGINT) || '%' AS share FROM orders""",
)
def number_format(spark, d):
    return b.table(spark, d, "orders").select(
        "o_orderkey",
        F.format_number("o_totalprice", 2).alias("thousands"),
        F.round(F.col("o_totalprice") / 1000).cast("bigint").cast("string").alias("plain"),
        percent_text((F.col("o_orderkey") % 1000) / 1000.0).alias("share"),
    )


@query(
    "q_period_arith",
    """WITH c AS (SELECT o_custkey, CAST(min(year(o_orderdate)*4 + quarter(o_orderdate) - 1) AS INTEGER) AS a,
                         CAST(max(year(o_orderdate)*4 + quarter(o_orderdate) - 1) AS INTEGER) AS z FROM orders GROUP BY 1)
       SELECT o_custkey, CAST(p AS INTEGER) AS period, z - a AS span, CAST(p + 4 AS INTEGER) AS year_later, CAST(p - 3 AS INTEGER) AS origin,
              CAST(make_date(p // 4, p % 4*3 + 1, 1) AS VARCHAR) AS first_day FROM c, unnest(range(a, z + 1)) t(p)""",
)
def period_arith(spark, d):
    period = quarter_index(F.col("o_orderdate"))
    spans = b.table(spark, d, "orders").groupBy("o_custkey").agg(F.min(period).alias("a"), F.max(period).alias("z"))
    rows = spans.withColumn("period", F.explode(F.sequence("a", "z")))
    return rows.select(
        "o_custkey",
        "period",
        (F.col("z") - F.col("a")).alias("span"),
        (F.col("period") + 4).alias("year_later"),
        (F.col("period") - 3).alias("origin"),
        quarter_start(F.col("period")).cast("string").alias("first_day"),
    )


@query(
    "q_math",
    f"""SELECT l_orderkey, l_linenumber, {r6('ln(l_extendedprice)')} AS log_price, {r6('pow(l_quantity, 1.5)')} AS powered,
               {r6('sqrt(l_extendedprice)')} AS root, {r6('abs(l_discount - 0.05)')} AS distance, CAST(ceil(l_extendedprice/7) AS BIGINT) AS up,
               CAST(floor(l_extendedprice/7) AS BIGINT) AS down, sign(l_quantity - 25) + 0.0 AS side FROM lineitem""",
)
def math(spark, d):
    return b.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        rounded(safe_log(F.col("l_extendedprice"))).alias("log_price"),
        rounded(F.pow("l_quantity", F.lit(1.5))).alias("powered"),
        rounded(F.sqrt("l_extendedprice")).alias("root"),
        rounded(F.abs(F.col("l_discount") - 0.05)).alias("distance"),
        F.ceil(F.col("l_extendedprice") / 7).alias("up"),
        F.floor(F.col("l_extendedprice") / 7).alias("down"),
        F.signum(F.col("l_quantity") - 25).alias("side"),
    )


@query(
    "q_normal_bands",
    f"""WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)
        SELECT o_custkey, n, {r6(f'm - {normal_quantile(95)!r}*s/sqrt(n)')} AS lower95, {r6(f'm + {normal_quantile(95)!r}*s/sqrt(n)')} AS upper95,
               {r6(f'm - {normal_quantile(80)!r}*s/sqrt(n)')} AS lower80, {r6(f'm + {normal_quantile(80)!r}*s/sqrt(n)')} AS upper80 FROM m""",
)
def normal_bands(spark, d):
    stats = b.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n")
    )
    out = []
    for level in (95, 80):
        low, high = band(F.col("m"), F.col("s") / F.sqrt("n"), level)
        out += [rounded(low).alias(f"lower{level}"), rounded(high).alias(f"upper{level}")]
    return stats.select("o_custkey", "n", *out)


_STATS = """s AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1 HAVING count(*) > 2),
  z AS (SELECT o_custkey, n, (m - 250000.0)/nullif(sd/sqrt(n), 0) AS t, (n - 1)*pow(sd/145000.0, 2) AS x FROM s)"""
_Z = """CASE WHEN abs(t) > 8 THEN CASE WHEN t > 0 THEN 0.0 ELSE 1.0 END WHEN t = 0 THEN 0.5 ELSE 0.5 - sign(t)*exp(-t*t/2)/sqrt(2*pi())
  *list_sum(list_transform(range(0, 200), lambda k: exp((2*k + 1)*ln(abs(t)) - ((k + 1)*ln(2.0) + lgamma(k + 1.5) - 0.5*ln(pi()))))) END"""


def _chi2_sql(x: str, df: int) -> str:
    terms = " + ".join(f"pow({x}/2, {i})/{f}.0" for i, f in zip(range(df // 2), (1, 1, 2, 6, 24)))
    return f"exp(-{x}/2)*({terms})"


@query(
    "q_tail_probability",
    f"""WITH {_STATS} SELECT o_custkey, n, {r6('t')} AS t, {r6(_Z)} AS p_normal, {r6(_chi2_sql('x', 10))} AS p_chi2, {r6(_chi2_sql('x', 10))} AS p_chi2_gamma,
               {r6(st.t_tail('t', '(n - 1)'))} AS p_t,
               {r6('pow(1 + t*t/4.0, -2)')} AS p_f FROM z""",
)
def tail_probability(spark, d):
    """Normal, chi-square (closed form and incomplete gamma), t and F tails of one statistic per customer.

    With 2 and 4 degrees of freedom the F tail is (1 + f / 2) ^ -2, evaluated at f = t ^ 2 / 2.
    """
    stats = b.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("sd")
    )
    z = stats.filter("n > 2").select(
        "o_custkey",
        "n",
        ratio(F.col("m") - 250000.0, F.col("sd") / F.sqrt("n")).alias("t"),
        ((F.col("n") - 1) * F.pow(F.col("sd") / 145000.0, F.lit(2.0))).alias("x"),
    )
    half_square = F.col("t") * F.col("t") / 2.0
    return z.select(
        "o_custkey",
        "n",
        rounded(F.col("t")).alias("t"),
        rounded(normal_sf("t")).alias("p_normal"),
        rounded(chi2_tail_even(F.col("x"), 10)).alias("p_chi2"),
        rounded(chi2_sf(F.col("x"), F.lit(10.0))).alias("p_chi2_gamma"),
        rounded(t_sf(F.col("t"), (F.col("n") - 1).cast("double"))).alias("p_t"),
        rounded(f_sf(half_square, F.lit(2.0), F.lit(4.0))).alias("p_f"),
    )


@query(
    "q_bucket_labels",
    f"""WITH {_STATS}, p AS (SELECT o_custkey, {_chi2_sql('x', 10)} AS p FROM z)
        SELECT o_custkey, {r6('p')} AS p, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' WHEN p IS NOT NULL THEN '' END AS mark FROM p""",
)
def bucket_labels(spark, d):
    stats = b.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("o_totalprice").alias("sd"))
    p = chi2_tail_even((F.col("n") - 1) * F.pow(F.col("sd") / 145000.0, F.lit(2.0)), 10)
    return stats.filter("n > 2").select("o_custkey", p.alias("p")).select("o_custkey", rounded(F.col("p")).alias("p"), stars(F.col("p")).alias("mark"))
