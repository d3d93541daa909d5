"""Queries on aggregation, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.scalars import ratio, rounded
from seriesloom.operators import aggregates, joins, ordering, reshape, stationary, windows
from seriesloom.plans import bindings as b
from seriesloom.plans.registry import CUT, query, r6, sql
from seriesloom.sources import literals

_W = "WINDOW w AS (PARTITION BY entity ORDER BY period)"


@query(
    "q_group_counts",
    """SELECT p_type, p_brand, n, CAST(sum(n) OVER (PARTITION BY p_type ORDER BY f, p_brand ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n
       FROM (SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2)""",
)
def group_counts(spark, d):
    return aggregates.group_counts(b.table(spark, d, "part"), "p_type", "p_brand", "p_partkey")


@query(
    "q_quantiles",
    f"""SELECT l_returnflag AS learner, {r6('quantile_cont(l_extendedprice, 0.25)')} AS q25, {r6('quantile_cont(l_extendedprice, 0.5)')} AS q50,
               {r6('quantile_cont(l_extendedprice, 0.75)')} AS q75, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
        FROM lineitem GROUP BY 1""",
)
def quantiles(spark, d):
    rows = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("learner"), "l_extendedprice")
    cuts = aggregates.exact_percentiles(rows, ["learner"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    ends = rows.groupBy("learner").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return cuts.join(ends, "learner").select("learner", *[rounded(F.col(c)).alias(c) for c in ("q25", "q50", "q75")], "lo", "hi")


@query("q_freq_table", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def freq_table(spark, d):
    return aggregates.value_counts(b.table(spark, d, "documents"), ["lang", "source"])


# Bin edges for the two tuning parameters of the heat map.
TREE_BREAKS = [1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50]
RATE_BREAKS = [0.0, 0.02, 0.04, 0.06, 0.08]


def _case(column: str, breaks: list[float], right: bool = True) -> str:
    arms = " ".join(
        f"WHEN {column} {'>' if right else '>='} {lo} AND {column} {'<=' if right else '<'} {hi} THEN {i}"
        for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]))
    )
    return f"CAST(CASE {arms} END AS INTEGER)"


@query(
    "q_binned_heatmap",
    sql(
        f"""SELECT {_case('trees', TREE_BREAKS)} AS bin_x, {_case('rate', RATE_BREAKS)} AS bin_y, count(*) AS n,
                   {r6('avg(rmse)')} AS mean_rmse FROM trials GROUP BY 1, 2""",
        "trials",
    ),
)
def binned_heatmap(spark, d):
    cells = aggregates.binned_means(b.trials(spark, d), "trees", TREE_BREAKS, "rate", RATE_BREAKS, "rmse")
    return cells.select("bin_x", "bin_y", "n", rounded(F.col("mean_value")).alias("mean_rmse"))


@query(
    "q_moments",
    sql(
        f"""SELECT entity, count(revenue) AS n, {r6('avg(revenue)')} AS mean, {r6('stddev_samp(revenue)')} AS sd,
                   round(min(revenue), 4) AS min, round(max(revenue), 4) AS max FROM flag_m GROUP BY 1""",
        "flag_m",
    ),
)
def moments(spark, d):
    out = aggregates.moments(b.flag_m(spark, d), ["entity"], "revenue")
    return out.select(
        "entity", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "sd")], *[rounded(F.col(c), 4).alias(c) for c in ("min", "max")]
    )


@query(
    "q_univariate_r2",
    f"""WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS y, unnest(embedding[2:]) AS v, generate_subscripts(embedding[2:], 1) AS i FROM embeddings)
        SELECT CAST(i AS INTEGER) AS feature, {r6('regr_r2(y, CAST(v AS DOUBLE))')} AS r2, count(*) AS n FROM x GROUP BY 1""",
)
def univariate_r2(spark, d):
    vectors = b.vectors(spark, d)
    long = vectors.select(
        F.col("v")[0].alias("y"), F.posexplode(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))).alias("i", "value")
    ).withColumn("feature", (F.col("i") + 1).cast("int"))
    out = aggregates.univariate_r2(long, ["feature"], "y", "value")
    return out.select("feature", rounded(F.col("r2")).alias("r2"), "n")


@query(
    "q_density",
    sql(
        f"""SELECT bin, n, {r6('n/(total*25.0)')} AS density, {r6('mean')} AS mean, {r6('sd')} AS sd FROM
              (SELECT CAST(floor((y + 100)/25.0) AS INTEGER) AS bin, count(*) AS n FROM growth_q WHERE y IS NOT NULL GROUP BY 1),
              (SELECT count(y) AS total, avg(y) AS mean, stddev_samp(y) AS sd FROM growth_q)""",
        "growth_q",
    ),
)
def density(spark, d):
    pooled = b.growth_q(spark, d).withColumn("panel", F.lit("growth"))
    out = aggregates.histogram_density(pooled, ["panel"], "y", -100.0, 25.0)
    return out.select("bin", "n", *[rounded(F.col(c)).alias(c) for c in ("density", "mean", "sd")])


@query(
    "q_accuracy_suite",
    sql(
        f"""+m AS (SELECT *, avg(CASE WHEN period <= {CUT} THEN y END) OVER (PARTITION BY entity) AS f, lag(y) OVER w AS prev FROM growth_q {_W}),
            e AS (SELECT *, CASE WHEN period > {CUT} THEN y - f END AS e, CASE WHEN period <= {CUT} THEN abs(y - prev) END AS s FROM m),
            c AS (SELECT *, e - avg(e) OVER (PARTITION BY entity) AS dd FROM e),
            l AS (SELECT *, lag(dd) OVER w AS dl FROM c {_W})
        SELECT entity, count(e) AS n, {r6('avg(e)')} AS me, {r6('sqrt(avg(e*e))')} AS rmse, {r6('avg(abs(e))')} AS mae,
               {r6('avg(100.0*e/nullif(y, 0))')} AS mpe, {r6('avg(abs(100.0*e/nullif(y, 0)))')} AS mape,
               {r6('avg(abs(e))/nullif(avg(s), 0)')} AS mase, {r6('sum(dd*dl)/nullif(sum(dd*dd), 0)')} AS acf1
        FROM l GROUP BY 1""",
        "growth_q",
    ),
)
def accuracy_suite(spark, d):
    panel = b.growth_q(spark, d)
    training = F.when(F.col("period") <= CUT, F.col("y"))
    flat = panel.withColumn("forecast", F.avg(training).over(W.partitionBy("entity")))
    tagged = flat.withColumn("role", reshape.split_label(F.col("period"), CUT))
    out = aggregates.accuracy_suite(tagged, ["entity"], "y", "forecast")
    names = ("me", "rmse", "mae", "mpe", "mape", "mase", "acf1")
    return out.select("entity", "n", *[rounded(F.col(c)).alias(c) for c in names])


# --- windows -----------------------------------------------------------------------------


@query(
    "q_growth",
    sql(
        f"""SELECT entity, period, {r6('g')} AS growth, {r6('a/1e6')} AS annualised_m, {r6('100.0*(pow(1.0 + a/100.0, 0.25) - 1.0)')} AS back
            FROM (SELECT *, 100.0*(value/nullif(lag(value) OVER w, 0) - 1.0) AS g,
                         100.0*(pow(value/nullif(lag(value) OVER w, 0), 4) - 1.0) AS a FROM nation_q {_W})""",
        "nation_q",
    ),
)
def growth(spark, d):
    out = b.nation_q(spark, d).select(
        "entity", "period", windows.growth("value", ["entity"]).alias("g"), windows.annualised_growth("value", ["entity"]).alias("a")
    )
    return out.select(
        "entity",
        "period",
        rounded(F.col("g")).alias("growth"),
        rounded(F.col("a") / 1e6).alias("annualised_m"),
        rounded(windows.deannualise(F.col("a"))).alias("back"),
    )


@query(
    "q_diff",
    sql(
        f"""SELECT entity, period, {r6('value - lag(value) OVER w')} AS d1,
                   {r6('value - 2*lag(value) OVER w + lag(value, 2) OVER w')} AS d2 FROM nation_q {_W}""",
        "nation_q",
    ),
)
def diff(spark, d):
    return b.nation_q(spark, d).select(
        "entity",
        "period",
        rounded(windows.difference("value", ["entity"])).alias("d1"),
        rounded(windows.difference("value", ["entity"], 2)).alias("d2"),
    )


@query(
    "q_lag_frame",
    sql(
        "SELECT entity, period, "
        + r6("revenue")
        + " AS revenue, "
        + ", ".join(f"{r6(f'lag({c}, {k}) OVER w')} AS {c}_l{k}" for c in ("revenue", "quantity", "discount") for k in (4, 5))
        + f" FROM flag_m {_W}",
        "flag_m",
    ),
)
def lag_frame(spark, d):
    out = windows.lag_frame(b.flag_m(spark, d), ["entity"], "revenue", ["quantity", "discount"], horizon=4, max_lag=2)
    return out.select("entity", "period", *[rounded(F.col(c)).alias(c) for c in out.columns[2:]])


@query(
    "q_lag_rows",
    sql(
        f"""SELECT entity, CAST(period + k AS INTEGER) AS period, 'growth' AS series, CAST(k AS INTEGER) AS lag, {r6('y')} AS lag_value
            FROM growth_q, (VALUES (1), (2), (3)) t(k)""",
        "growth_q",
    ),
)
def lag_rows(spark, d):
    long = b.growth_q(spark, d).select("entity", F.lit("growth").alias("series"), "period", rounded(F.col("y")).alias("y"))
    return windows.lag_rows(long, ["entity"], "series", "y", [1, 2, 3])


@query(
    "q_revision_flag",
    """WITH c AS (SELECT lang, CAST(n_chars // 100 AS BIGINT) AS size_class, count(*) AS n FROM documents GROUP BY 1, 2)
       SELECT lang, size_class, n, CASE WHEN lag(n) OVER w IS NOT NULL AND n <> lag(n) OVER w THEN 'yes' ELSE 'no' END AS revision
       FROM c WINDOW w AS (PARTITION BY lang ORDER BY size_class)""",
)
def revision_flag(spark, d):
    size = F.floor(F.col("n_chars") / 100).cast("bigint")
    counts = b.table(spark, d, "documents").groupBy("lang", size.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("revision", windows.revision_flag("n", ["lang"], "size_class"))


@query(
    "q_cumsum",
    sql(
        f"""SELECT entity, period, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS cum_value,
                   {r6('sum(value) OVER (w ROWS UNBOUNDED PRECEDING)/sum(value) OVER (PARTITION BY entity)')} AS cum_share
            FROM nation_q {_W}""",
        "nation_q",
    ),
)
def cumsum(spark, d):
    running = F.sum("value").over(windows.expanding(["entity"]))
    return b.nation_q(spark, d).select(
        "entity",
        "period",
        rounded(running, 2).alias("cum_value"),
        rounded(ratio(running, F.sum("value").over(W.partitionBy("entity")))).alias("cum_share"),
    )


def _frame_sql(frame: str) -> str:
    return sql(
        f"""SELECT entity, period, CAST(count(x) OVER f AS BIGINT) AS n, {r6('avg(x) OVER f')} AS mean, {r6('stddev_samp(x) OVER f')} AS sd,
                   {r6('min(x) OVER f')} AS lo, {r6('max(x) OVER f')} AS hi
            FROM event_h WINDOW f AS (PARTITION BY entity ORDER BY period ROWS {frame})""",
        "event_h",
    )


def _frame(panel, w):
    return panel.select(
        "entity",
        "period",
        F.count("x").over(w).alias("n"),
        rounded(F.avg("x").over(w)).alias("mean"),
        rounded(F.stddev_samp("x").over(w)).alias("sd"),
        rounded(F.min("x").over(w)).alias("lo"),
        rounded(F.max("x").over(w)).alias("hi"),
    )


@query("q_expanding_agg", _frame_sql("UNBOUNDED PRECEDING"))
def expanding_agg(spark, d):
    return _frame(b.event_h(spark, d), windows.expanding(["entity"]))


@query("q_sliding_agg", _frame_sql("BETWEEN 23 PRECEDING AND CURRENT ROW"))
def sliding_agg(spark, d):
    return _frame(b.event_h(spark, d), windows.trailing(["entity"], 24))


@query(
    "q_topn_ties",
    sql(
        """SELECT learner, trial_id, trees FROM (SELECT *, rank() OVER (PARTITION BY learner ORDER BY trees) AS r FROM trials) WHERE r <= 30""",
        "trials",
    ),
)
def topn_ties(spark, d):
    """Trees are small integers: hundreds of rows tie at the boundary and all of them stay."""
    return windows.top_with_ties(b.trials(spark, d), ["learner"], "trees", 30).select("learner", "trial_id", "trees")


@query(
    "q_minmax_rescale",
    sql(
        f"""SELECT learner, trial_id, {r6('(rmse - min(rmse) OVER p)/(max(rmse) OVER p - min(rmse) OVER p)')} AS rescaled
            FROM trials WINDOW p AS (PARTITION BY learner)""",
        "trials",
    ),
)
def minmax_rescale(spark, d):
    out = windows.minmax_rescale(b.trials(spark, d), ["learner"], "rmse")
    return out.select("learner", "trial_id", rounded(F.col("rescaled")).alias("rescaled"))


@query(
    "q_dual_axis_scale",
    sql(
        f"""+s AS (SELECT entity, floor(min(y)) AS p0, ceil(max(y)) AS p1, ceil(min(value)) AS s0, ceil(max(value)) AS s1 FROM growth_q GROUP BY 1)
        SELECT entity, period, {r6('p0 - (p1 - p0)/nullif(s1 - s0, 0)*s0 + (p1 - p0)/nullif(s1 - s0, 0)*value')} AS scaled
        FROM growth_q JOIN s USING (entity)""",
        "growth_q",
    ),
)
def dual_axis(spark, d):
    out = windows.dual_axis(b.growth_q(spark, d), ["entity"], "y", "value")
    return out.select("entity", "period", rounded(F.col("scaled")).alias("scaled"))


@query(
    "q_zscore",
    sql(
        f"""SELECT entity, period, {r6('(y - avg(y) OVER p)/nullif(stddev_samp(y) OVER p, 0)')} AS z_all,
                   {r6(f'(y - avg(y) FILTER (period <= {CUT}) OVER p)/nullif(stddev_samp(y) FILTER (period <= {CUT}) OVER p, 0)')} AS z_train
            FROM growth_q WINDOW p AS (PARTITION BY entity)""",
        "growth_q",
    ),
)
def zscore(spark, d):
    both = windows.zscore(b.growth_q(spark, d), ["entity"], "y", name="z_all")
    both = windows.zscore(both, ["entity"], "y", F.col("period") <= CUT, "z_train")
    return both.select("entity", "period", rounded(F.col("z_all")).alias("z_all"), rounded(F.col("z_train")).alias("z_train"))


# --- orders and sets ---------------------------------------------------------------------


@query("q_arrange", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def arrange(spark, d):
    rows = b.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ordering.arrange(rows, F.col("c_mktsegment").asc(), F.col("c_acctbal").desc(), F.col("c_custkey").asc())


_PRIORITIES = ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH"]


@query(
    "q_custom_order",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CASE o_orderpriority "
    + " ".join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(_PRIORITIES))
    + " END AS pos FROM orders GROUP BY 1, 2 ORDER BY pos NULLS LAST",
)
def custom_order(spark, d):
    counts = aggregates.value_counts(b.table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])
    order = literals.literal_table(spark, [(p, i + 1) for i, p in enumerate(_PRIORITIES)], "o_orderpriority string, pos int")
    return ordering.custom_order(counts, order, "o_orderpriority")


@query(
    "q_order_within",
    """WITH g AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
       SELECT p_type, p_brand, n, CAST(row_number() OVER (PARTITION BY p_type ORDER BY n, p_brand) AS INTEGER) AS pos FROM g""",
)
def order_within(spark, d):
    groups = aggregates.value_counts(b.table(spark, d, "part"), ["p_type", "p_brand"])
    return ordering.order_within(groups, "p_type", "n", "p_brand")


@query(
    "q_union_by_name",
    """SELECT c_custkey AS party, c_nationkey AS nation, c_mktsegment AS segment, NULL AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier""",
)
def union_by_name(spark, d):
    buyers = b.table(spark, d, "customer").selectExpr("c_custkey AS party", "c_nationkey AS nation", "c_mktsegment AS segment")
    sellers = b.table(spark, d, "supplier").selectExpr("s_suppkey AS party", "s_nationkey AS nation", "s_acctbal AS balance")
    return ordering.bind_rows(buyers, sellers)


@query(
    "q_series_intersect",
    """WITH l AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), p AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 25)
       SELECT k, 'both' AS status FROM (SELECT * FROM l INTERSECT SELECT * FROM p)
       UNION ALL SELECT k, 'missing_right' FROM (SELECT * FROM l EXCEPT SELECT * FROM p)
       UNION ALL SELECT k, 'missing_left' FROM (SELECT * FROM p EXCEPT SELECT * FROM l)""",
)
def series_intersect(spark, d):
    left = b.table(spark, d, "lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("k"))
    right = b.table(spark, d, "part").filter(F.col("p_size") > 25).select(F.col("p_partkey").alias("k"))
    both = ordering.common_keys(left, right, "k").withColumn("status", F.lit("both"))
    odd = ordering.mismatch_report(left, right, "k").select("k", F.concat(F.lit("missing_"), "missing_in").alias("status"))
    return both.unionByName(odd)


@query(
    "q_series_except",
    """SELECT c_nationkey AS k, c_mktsegment AS segment FROM customer
       EXCEPT (SELECT s_nationkey, 'BUILDING' FROM supplier UNION ALL SELECT n_nationkey, 'MACHINERY' FROM nation)""",
)
def series_except(spark, d):
    everyone = b.table(spark, d, "customer").selectExpr("c_nationkey AS k", "c_mktsegment AS segment")
    first = b.table(spark, d, "supplier").selectExpr("s_nationkey AS k", "'BUILDING' AS segment")
    second = b.table(spark, d, "nation").selectExpr("n_nationkey AS k", "'MACHINERY' AS segment")
    return ordering.minus_keys(everyone, first, second)


@query("q_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(spark, d):
    return b.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


# --- stationarity transforms ---------------------------------------------------------------

_TS = f"""ts AS (SELECT q.*, code, lag(value) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM nation_q q JOIN codes ON entity = series {_W}),
  st AS (SELECT *, CASE code WHEN 2 THEN value - x1 WHEN 3 THEN value - 2*x1 + x2 WHEN 4 THEN ln(value) WHEN 5 THEN 100.0*(ln(value) - ln(x1))
         WHEN 6 THEN 100.0*(ln(value) - 2*ln(x1) + ln(x2)) WHEN 7 THEN 100.0*((value/x1 - 1.0) - (x1/x2 - 1.0)) ELSE value END AS moved FROM ts)"""


@query(
    "q_stationary",
    sql(f"+{_TS} SELECT entity, period, code, {r6('moved')} AS stationary FROM st", "nation_q", "codes"),
)
def make_stationary(spark, d):
    out = stationary.make_stationary(b.nation_q(spark, d), b.codes(spark, d), ["entity"], "entity")
    return out.select("entity", "period", "code", rounded(F.col("stationary")).alias("stationary"))


@query(
    "q_stationary_panel",
    sql(
        f"""+{_TS} SELECT entity, period, {r6('value')} AS level, {r6('moved')} AS stationary FROM
            (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS r FROM st) WHERE r > 2""",
        "nation_q", "codes",
    ),
)
def stationary_panel(spark, d):
    out = stationary.stationary_panel(b.nation_q(spark, d), b.codes(spark, d), ["entity"], "entity")
    return out.select("entity", "period", rounded(F.col("value")).alias("level"), rounded(F.col("stationary")).alias("stationary"))
