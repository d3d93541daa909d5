"""Queries on forecast records: baselines, origins, accuracy, tests, regimes, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.scalars import cut_label, rounded, stars
from seriesloom.functions.tails import normal_sf, t_sf
from seriesloom.operators import aggregates, evaluate, folds, joins, windows
from seriesloom.operators.baselines import baseline_records, direct_predictions, residuals_ar_one
from seriesloom.plans import bindings as b
from seriesloom.plans import sqltools as st
from seriesloom.plans.registry import CUT, query, r6, sql
from seriesloom.sources import literals

NUMBERS = ("true_value", "mean", "lower", "upper", "error")
RECORD = ("entity", "model_id", "horizon", "training_end", "periods_ahead", "forecast_period")
_RECORD_SQL = ", ".join(RECORD) + ", " + ", ".join(f"{r6(c)} AS {c}" for c in NUMBERS) + ", strategy, band_kind"


def records(spark, d, horizons=(1, 4), models=("RW", "MEAN", "ARIMA")):
    return baseline_records(b.growth_q(spark, d), ["entity"], "y", CUT, b.quarters(spark, d)[1], horizons, models)


def _show(rows, *extra):
    return rows.select(*RECORD, *[rounded(F.col(c)).alias(c) for c in NUMBERS], "strategy", "band_kind", *extra)


@query(
    "q_flagship",
    sql(
        f"""SELECT entity, regime_id IS NOT NULL AS in_regime, {r6('sqrt(avg(error*error))')} AS rmse, count(error) AS n
            FROM records LEFT JOIN regimes ON forecast_period BETWEEN s AND e WHERE model_id = 'RW_Q' GROUP BY 1, 2""",
        "records", "regimes",
    ),
)
def flagship(spark, d):
    rows = records(spark, d, (1,), ("RW",))
    flagged = joins.regime_join(rows, literals.recessions(spark), "forecast_period")
    return flagged.groupBy("entity", "in_regime").agg(
        rounded(F.sqrt(F.avg(F.col("error") * F.col("error")))).alias("rmse"), F.count("error").alias("n")
    )


@query("q_backtest_records", sql(f"SELECT {_RECORD_SQL} FROM records", "records"))
def backtest_records(spark, d):
    return _show(records(spark, d))


@query("q_rw_backtest", sql(f"SELECT {_RECORD_SQL} FROM records WHERE model_id LIKE 'RW%'", "records"))
def rw_backtest(spark, d):
    return _show(records(spark, d, models=("RW",)))


@query("q_ar_expanding", sql(f"SELECT {_RECORD_SQL} FROM records WHERE model_id LIKE 'ARIMA%'", "records"))
def ar_expanding(spark, d):
    return _show(records(spark, d, models=("ARIMA",)))


@query(
    "q_residuals",
    sql(
        f"""SELECT entity, period, {r6('x')} AS x, {r6('x - (regr_intercept(x, p) OVER e + (regr_slope(x, p) OVER e)*p)')} AS residual FROM
              (SELECT *, lag(x) OVER (PARTITION BY entity ORDER BY period) AS p FROM event_h)
            WINDOW e AS (PARTITION BY entity) QUALIFY p IS NOT NULL""",
        "event_h",
    ),
)
def residuals(spark, d):
    out = residuals_ar_one(b.event_h(spark, d), ["entity"], "x")
    return out.select("entity", "period", rounded(F.col("x")).alias("x"), rounded(F.col("residual")).alias("residual"))


_DIRECT = """direct AS (SELECT entity, period, y AS truth, lag(i, {h}) OVER w + (lag(s, {h}) OVER w)*(lag(y, {h}) OVER w) AS response, lag(v, {h}) OVER w AS se FROM (
      SELECT entity, period, y, CASE WHEN regr_count(y, x) OVER e >= 3 THEN regr_slope(y, x) OVER e END AS s,
             CASE WHEN regr_count(y, x) OVER e >= 3 THEN regr_intercept(y, x) OVER e END AS i,
             CASE WHEN regr_count(y, x) OVER e >= 3 THEN sqrt(greatest(0.0, (regr_syy(y, x) OVER e)*(1.0 - regr_r2(y, x) OVER e)/(regr_count(y, x) OVER e))) END AS v
      FROM (SELECT *, lag(y, {h}) OVER (PARTITION BY entity ORDER BY period) AS x FROM growth_q)
      WINDOW e AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY entity ORDER BY period))"""


@query(
    "q_ml_records",
    sql(
        f"""+{_DIRECT.format(h=4)} SELECT entity, 'LM_Y_I1' AS model_id, 'Y' AS horizon, CAST(period - 4 AS INTEGER) AS training_end, 4 AS periods_ahead,
              period AS forecast_period, {r6('truth')} AS true_value, {r6('response')} AS mean, {r6('response - se')} AS lower,
              {r6('response + se')} AS upper, {r6('truth - response')} AS error, 'direct' AS strategy, CASE WHEN se IS NOT NULL THEN '1se' END AS band_kind
            FROM direct WHERE period > {CUT}""",
        "growth_q",
    ),
)
def ml_records(spark, d):
    predictions = direct_predictions(b.growth_q(spark, d), ["entity"], "y", 4).filter(F.col("period") > CUT)
    return _show(evaluate.ml_records(predictions, ["entity"], "LM_Y_I1", 4, "Y"))


@query(
    "q_origins",
    sql(
        f"""SELECT entity, CAST(o - {CUT - 3} + 1 AS INTEGER) AS iteration, CAST(o AS INTEGER) AS training_end,
                   CAST(o + 1 AS INTEGER) AS testing_start, CAST(o + 4 AS INTEGER) AS last_forecast
            FROM (SELECT entity, max(period) AS e FROM nation_q GROUP BY 1), range({CUT - 3}, 8100) t(o) WHERE o <= e - 4""",
        "nation_q",
    ),
)
def origins(spark, d):
    return folds.origins(b.nation_q(spark, d), ["entity"], CUT, 4)


_SETS = ", ".join(f"({i}, '{h}', '{m}')" for i, h, m in literals.model_set_rows())


@query(
    "q_information_sets",
    sql(
        f"""SELECT info_set, model_id, count(error) AS n, {r6('sqrt(avg(error*error))')} AS rmse
            FROM records JOIN (VALUES {_SETS}) t(info_set, hz, mid) ON mid = model_id GROUP BY 1, 2""",
        "records",
    ),
)
def information_sets(spark, d):
    sets = literals.model_sets(spark).select("info_set", "model_id")
    chosen = records(spark, d).join(sets, "model_id")
    return chosen.groupBy("info_set", "model_id").agg(
        F.count("error").alias("n"), rounded(F.sqrt(F.avg(F.col("error") * F.col("error")))).alias("rmse")
    )


@query(
    "q_forecast_actual_join",
    sql(
        f"""SELECT g.entity, g.period, m.model_id, {r6('y')} AS actual, {r6('mean')} AS mean, {r6('lower')} AS lower, {r6('upper')} AS upper
            FROM growth_q g CROSS JOIN (VALUES ('RW_Q'), ('ARIMA_Q')) m(model_id)
            LEFT JOIN records r ON r.entity = g.entity AND r.forecast_period = g.period AND r.model_id = m.model_id""",
        "records",
    ),
)
def forecast_actual_join(spark, d):
    models = F.explode(F.array(F.lit("RW_Q"), F.lit("ARIMA_Q")))
    actual = b.growth_q(spark, d).select("entity", "period", F.col("y").alias("actual"), models.alias("model_id"))
    made = records(spark, d).select("entity", F.col("forecast_period").alias("period"), "model_id", "mean", "lower", "upper")
    joined = actual.join(made, ["entity", "period", "model_id"], "left")
    return joined.select("entity", "period", "model_id", *[rounded(F.col(c)).alias(c) for c in ("actual", "mean", "lower", "upper")])


_METRICS = f"""count(error) AS n, {r6('avg(error*error)/1e6')} AS mse, {r6('sqrt(avg(error*error))')} AS rmse, {r6('avg(abs(error))')} AS mae,
  {r6('avg(error)')} AS me, {r6('median(abs(error))')} AS mdae, {r6('median(abs(rel_error))')} AS mdrae"""


def _shown_metrics():
    """Mean squares are shown in millions to keep their rounding meaningful."""
    return [rounded(F.col(c) / 1e6 if c == "mse" else F.col(c)).alias(c) for c in _METRIC_NAMES]


_METRIC_NAMES = ("mse", "rmse", "mae", "me", "mdae", "mdrae")


@query("q_error_metrics", sql(f"SELECT model_id, {_METRICS} FROM rel GROUP BY 1", "rel"))
def error_metrics(spark, d):
    rel = evaluate.relative_errors(records(spark, d), ["entity"], "RW")
    out = evaluate.error_metrics(rel, ["model_id"])
    return out.select("model_id", "n", *_shown_metrics())


@query("q_error_metrics_series", sql(f"SELECT entity, model_id, {_METRICS} FROM rel GROUP BY 1, 2", "rel"))
def error_metrics_series(spark, d):
    rel = evaluate.relative_errors(records(spark, d), ["entity"], "RW")
    out = evaluate.error_metrics(rel, ["entity", "model_id"], bounded=True)
    return out.select("entity", "model_id", "n", *_shown_metrics())


@query(
    "q_sign_hit_rate",
    sql(
        f"""SELECT model_id, count(*) AS n_periods, CAST(sum(CASE WHEN sign(true_value) = sign(mean) THEN 1 ELSE 0 END) AS BIGINT) AS right_sign
            FROM records WHERE forecast_period BETWEEN 8001 AND 8005 GROUP BY 1""",
        "records",
    ),
)
def sign_hit_rate(spark, d):
    return evaluate.sign_hits(records(spark, d), ["model_id"], 8001, 8005)


@query(
    "q_ratio_to_benchmark",
    sql(
        f"""+m AS (SELECT entity, model_id, horizon, sqrt(avg(error*error)) AS rmse FROM records GROUP BY 1, 2, 3)
            SELECT a.entity, a.model_id, {r6('a.rmse')} AS rmse, {r6('a.rmse/nullif(b.rmse, 0)')} AS relative, {r6('1.0 - a.rmse/nullif(b.rmse, 0)')} AS gain
            FROM m a LEFT JOIN m b ON a.entity = b.entity AND a.horizon = b.horizon AND b.model_id = 'RW_' || b.horizon""",
        "records",
    ),
)
def ratio_to_benchmark(spark, d):
    metrics = records(spark, d).groupBy("entity", "model_id", "horizon").agg(
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")
    )
    bench = F.concat(F.lit("RW_"), F.col("horizon"))
    out = windows.ratio_to_benchmark(metrics, ["entity", "horizon"], "model_id", bench, "rmse")
    return out.select("entity", "model_id", *[rounded(F.col(c)).alias(c) for c in ("rmse", "relative", "gain")])


@query(
    "q_relative_error",
    sql(f"SELECT entity, model_id, forecast_period, {r6('error')} AS error, {r6('rel_error')} AS rel_error FROM rel", "rel"),
)
def relative_error(spark, d):
    rel = evaluate.relative_errors(records(spark, d), ["entity"], "RW")
    return rel.select("entity", "model_id", "forecast_period", rounded(F.col("error")).alias("error"), rounded(F.col("rel_error")).alias("rel_error"))


PAIRS = [("ARIMA", "RW"), ("MEAN", "RW"), ("ARIMA", "MEAN")]


def _dm_sql(power: int, adjusted: bool) -> str:
    factor = "sqrt(greatest(0.0, (n + 1 - 2*h + h*(h - 1.0)/n)/n))" if adjusted else "1.0"
    pairs = ", ".join(f"('{m}', '{bench}')" for m, bench in PAIRS)
    return f"""+d AS (SELECT m.entity, m.horizon, m.periods_ahead AS h, p.model, p.benchmark, m.forecast_period,
             pow(abs(k.error), {power}) - pow(abs(m.error), {power}) AS d
           FROM records m JOIN (VALUES {pairs}) p(model, benchmark) ON m.model_id = p.model || '_' || m.horizon
           JOIN records k ON k.entity = m.entity AND k.horizon = m.horizon AND k.forecast_period = m.forecast_period
                AND k.model_id = p.benchmark || '_' || k.horizon WHERE k.error IS NOT NULL AND m.error IS NOT NULL),
        c AS (SELECT *, d - avg(d) OVER (PARTITION BY entity, horizon, model, benchmark) AS c FROM d),
        l AS (SELECT *, c*lag(c, 1) OVER w AS g1, c*lag(c, 2) OVER w AS g2, c*lag(c, 3) OVER w AS g3 FROM c
              WINDOW w AS (PARTITION BY entity, horizon, model, benchmark ORDER BY forecast_period)),
        a AS (SELECT entity, horizon, h, model, benchmark, count(d) AS n, avg(d) AS mean_d,
                (sum(c*c) + 2.0*CASE WHEN h > 1 THEN coalesce(sum(g1), 0) + coalesce(sum(g2), 0) + coalesce(sum(g3), 0) ELSE 0 END)/(count(d)*count(d)) AS v
              FROM l GROUP BY entity, horizon, h, model, benchmark),
        s AS (SELECT *, CASE WHEN v > 0 AND n > h THEN mean_d/sqrt(v)*{factor} END AS statistic FROM a)"""


@query(
    "q_dm_test",
    sql(
        f"""{_dm_sql(2, True)} SELECT entity, horizon, model, benchmark, n, {r6('mean_d')} AS mean_d, {r6('statistic')} AS statistic,
            {r6(st.t_tail('statistic', '(n - 1)'))} AS p_greater FROM s""",
        "records",
    ),
)
def dm_test(spark, d):
    """Squared loss, with the one-sided p-value of the t(n - 1) law."""
    out = evaluate.dm_statistic(records(spark, d), ["entity"], PAIRS, 2, True)
    p = t_sf(F.col("statistic"), (F.col("n") - 1).cast("double"))
    return out.select(
        "entity", "horizon", "model", "benchmark", "n", rounded(F.col("mean_d")).alias("mean_d"),
        rounded(F.col("statistic")).alias("statistic"), rounded(p).alias("p_greater"),
    )


@query(
    "q_dm_pvalues",
    sql(
        f"""{_dm_sql(1, True)}, p AS (SELECT *, {st.t_tail('statistic', '(n - 1)')} AS p FROM s)
        SELECT entity, horizon, model, benchmark, n, {r6('statistic')} AS statistic, {r6('p')} AS p_greater,
               CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' WHEN p IS NOT NULL THEN '' END AS mark FROM p""",
        "records",
    ),
)
def dm_pvalues(spark, d):
    """Absolute loss, with the t(n - 1) p-value at every series length and its mark."""
    out = evaluate.dm_statistic(records(spark, d), ["entity"], PAIRS, 1, True)
    p = out.withColumn("p", t_sf(F.col("statistic"), (F.col("n") - 1).cast("double")))
    return p.select(
        "entity", "horizon", "model", "benchmark", "n", rounded(F.col("statistic")).alias("statistic"),
        rounded(F.col("p")).alias("p_greater"), stars(F.col("p")).alias("mark"),
    )


_MODELS = ("RW", "MEAN", "ARIMA")
_TABLE_SQL = f"""+e AS (SELECT *, regexp_replace(model_id, '_[QY]$', '') AS model FROM records WHERE error IS NOT NULL),
    whole AS (SELECT entity, horizon, forecast_period FROM e GROUP BY 1, 2, 3 HAVING count(DISTINCT model) = {len(_MODELS)}),
    d AS (SELECT a.entity, a.horizon, a.periods_ahead AS h, a.model, b.model AS benchmark, a.forecast_period AS t, b.error*b.error - a.error*a.error AS d
          FROM e a JOIN e b USING (entity, horizon, forecast_period) JOIN whole USING (entity, horizon, forecast_period) WHERE a.model <> b.model),
    c AS (SELECT *, d - avg(d) OVER (PARTITION BY entity, horizon, model, benchmark) AS c FROM d),
    g AS (SELECT x.entity, x.horizon, x.model, x.benchmark, sum(CASE WHEN x.t - y.t = 0 THEN 1 WHEN x.t - y.t BETWEEN 1 AND x.h - 1 THEN 2 ELSE 0 END*x.c*y.c) AS v
          FROM c x JOIN c y ON x.entity = y.entity AND x.horizon = y.horizon AND x.model = y.model AND x.benchmark = y.benchmark AND y.t BETWEEN x.t - 3 AND x.t GROUP BY 1, 2, 3, 4),
    a AS (SELECT entity, horizon, h, model, benchmark, count(*) AS n, avg(d) AS mean_d FROM d GROUP BY 1, 2, 3, 4, 5),
    s AS (SELECT *, CASE WHEN v > 0 AND n > h THEN mean_d/sqrt(v/(n*n))*sqrt(greatest(0.0, (n + 1 - 2*h + h*(h - 1.0)/n)/n)) END AS statistic
          FROM a JOIN g USING (entity, horizon, model, benchmark))"""


@query(
    "q_dm_table",
    sql(
        f"""{_TABLE_SQL} SELECT entity, horizon, model, benchmark, n, {r6('sign(mean_d)*ln(1 + abs(mean_d))')} AS mean_d_log, {r6('statistic')} AS statistic,
            {r6(st.t_tail('statistic', '(n - 1)'))} AS p_greater FROM s""",
        "records",
    ),
)
def dm_table(spark, d):
    """Every model against every other on the targets that all have, with the t(n - 1) p-value; mean differences on a signed log scale."""
    out = evaluate.all_comparisons(records(spark, d), ["entity"], list(_MODELS))
    p = t_sf(F.col("statistic"), (F.col("n") - 1).cast("double"))
    return out.select(
        "entity", "horizon", "model", "benchmark", "n", rounded(F.signum("mean_d") * F.log1p(F.abs("mean_d"))).alias("mean_d_log"),
        rounded(F.col("statistic")).alias("statistic"), rounded(p).alias("p_greater"),
    )


_PHI = """CASE WHEN statistic IS NULL THEN NULL WHEN abs(statistic) > 8 THEN CASE WHEN statistic > 0 THEN 0.0 ELSE 1.0 END WHEN statistic = 0 THEN 0.5 ELSE
   0.5 - sign(statistic)*exp(-statistic*statistic/2)/sqrt(2*pi())*list_sum(list_transform(range(0, 200),
   lambda k: exp((2*k + 1)*ln(abs(statistic)) - ((k + 1)*ln(2.0) + lgamma(k + 1.5) - 0.5*ln(pi()))))) END"""


@query(
    "q_dm_test_normal",
    sql(
        f"""{_dm_sql(1, False)} SELECT entity, horizon, model, benchmark, n, {r6('statistic')} AS statistic, {r6(_PHI)} AS p_greater FROM s""",
        "records",
    ),
)
def dm_test_normal(spark, d):
    out = evaluate.dm_statistic(records(spark, d), ["entity"], PAIRS, 1, False)
    return out.select(
        "entity", "horizon", "model", "benchmark", "n", rounded(F.col("statistic")).alias("statistic"),
        rounded(normal_sf(F.col("statistic"))).alias("p_greater"),
    )


@query(
    "q_dm_heatmap",
    sql(
        f"""{_dm_sql(1, False)}, p AS (SELECT *, {r6(_PHI)} AS p_value FROM s),
        m AS (SELECT entity, horizon, model_id, sqrt(avg(error*error)) AS rmse FROM records GROUP BY 1, 2, 3),
        g AS (SELECT p.*, round(1.0 - a.rmse/nullif(b.rmse, 0), 2) AS gain FROM p
              LEFT JOIN m a ON a.entity = p.entity AND a.model_id = p.model || '_' || p.horizon
              LEFT JOIN m b ON b.entity = p.entity AND b.model_id = p.benchmark || '_' || p.horizon)
        SELECT entity, horizon, model, benchmark, p_value,
               CASE WHEN p_value < 0.01 THEN '[-Inf,0.01)' WHEN p_value < 0.05 THEN '[0.01,0.05)' WHEN p_value < 0.1 THEN '[0.05,0.1)'
                    WHEN p_value < 1 THEN '[0.1,1)' END AS p_range,
               CASE WHEN gain > 0 THEN 'Increase' WHEN gain IS NOT NULL THEN 'Worsening' END AS direction,
               CAST(round(gain*100) AS BIGINT) || '%' AS gain_text FROM g""",
        "records",
    ),
)
def dm_heatmap(spark, d):
    rows = records(spark, d)
    on = ["entity", "horizon", "model", "benchmark"]
    tests = evaluate.dm_statistic(rows, ["entity"], PAIRS, 1, False).select(
        *on, rounded(normal_sf(F.col("statistic"))).alias("p_value")
    )
    metrics = rows.groupBy("entity", "horizon", "model_id").agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    return evaluate.heatmap_rows(tests, evaluate.pair_gains(metrics, ["entity"], PAIRS), on)


_ORDER = ", ".join(f"('{m}', {i + 1}, '{label}')" for i, (m, label) in enumerate(literals.MODEL_LABELS))


@query(
    "q_accuracy_table",
    sql(
        f"""+m AS (SELECT regexp_replace(model_id, '_[QY]$', '') AS model, horizon, sqrt(avg(error*error)) AS rmse, median(abs(rel_error)) AS mdrae
                   FROM rel GROUP BY 1, 2),
            b AS (SELECT horizon, rmse AS base FROM m WHERE model = 'RW')
        SELECT model, pos, label, {', '.join(f"{r6(f'max(CASE WHEN horizon = {chr(39)}{h}{chr(39)} THEN {e} END)')} AS {c}_{h.lower()}" for h in 'QY' for c, e in (('rmse', 'rmse'), ('mdrae', 'mdrae'), ('relrmse', 'rmse/nullif(base, 0)')))}
        FROM m JOIN b USING (horizon) LEFT JOIN (VALUES {_ORDER}) o(mid, pos, label) ON mid = model GROUP BY 1, 2, 3""",
        "rel",
    ),
)
def accuracy_table(spark, d):
    out = evaluate.accuracy_table(records(spark, d), ["entity"], "RW", literals.model_order(spark))
    names = [f"{c}_{h}" for h in ("q", "y") for c in ("rmse", "mdrae", "relrmse")]
    return out.select("model", "pos", "label", *[rounded(F.col(c)).alias(c) for c in names])


@query(
    "q_crisis_window",
    sql(
        f"""SELECT entity, model_id, forecast_period, {r6('true_value')} AS true_value, {r6('mean')} AS mean,
                   CASE WHEN model_id <> 'MEAN_Q' THEN {r6('lower')} END AS lower, CASE WHEN model_id <> 'MEAN_Q' THEN {r6('upper')} END AS upper,
                   regime_id IS NOT NULL AS in_regime
            FROM records LEFT JOIN regimes ON forecast_period BETWEEN s AND e WHERE horizon = 'Q' AND forecast_period BETWEEN 8001 AND 8005""",
        "records", "regimes",
    ),
)
def crisis_window(spark, d):
    rows = records(spark, d).filter((F.col("horizon") == "Q") & F.col("forecast_period").between(8001, 8005))
    flagged = joins.regime_join(evaluate.blank_bands(rows, ["MEAN_Q"]), literals.recessions(spark), "forecast_period")
    numbers = ("true_value", "mean", "lower", "upper")
    return flagged.select("entity", "model_id", "forecast_period", *[rounded(F.col(c)).alias(c) for c in numbers], "in_regime")


@query(
    "q_blank_bands",
    sql(
        f"""SELECT entity, model_id, forecast_period, CASE WHEN model_id NOT IN ('RW_Q', 'RW_Y') THEN {r6('lower')} END AS lower,
                   CASE WHEN model_id NOT IN ('RW_Q', 'RW_Y') THEN {r6('upper')} END AS upper FROM records""",
        "records",
    ),
)
def blank_bands(spark, d):
    rows = evaluate.blank_bands(records(spark, d), ["RW_Q", "RW_Y"])
    return rows.select("entity", "model_id", "forecast_period", rounded(F.col("lower")).alias("lower"), rounded(F.col("upper")).alias("upper"))


@query(
    "q_label_lookup",
    sql(
        f"""SELECT regexp_replace(model_id, '_[QY]$', '') AS model_id, label, pos, count(*) AS n FROM records
            LEFT JOIN (VALUES {_ORDER}) o(mid, pos, label) ON mid = regexp_replace(model_id, '_[QY]$', '') GROUP BY 1, 2, 3""",
        "records",
    ),
)
def label_lookup(spark, d):
    named = records(spark, d).select(F.regexp_replace("model_id", "_[QY]$", "").alias("model_id"))
    counts = named.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(literals.model_order(spark), "model_id", "left").select("model_id", "label", "pos", "n")


# --- folds and candidates ------------------------------------------------------------------


def _folds_sql(gap: int, growing: bool) -> str:
    begin = "1" if growing else "test - initial"
    return sql(
        f"""+f AS (SELECT entity, period, y, row_number() OVER (PARTITION BY entity ORDER BY period) AS r, count(*) OVER (PARTITION BY entity) AS n
                   FROM growth_q WHERE y IS NOT NULL AND period <= {CUT}),
            t AS (SELECT *, greatest(n - 11, 1) AS initial, greatest(n - 11, 1) + 1 + k*2 AS test, k FROM f, range(0, 20) t(k) WHERE k <= (n - greatest(n - 11, 1) - 1)//2)
        SELECT entity, period, {r6('y')} AS y, CAST(k + 1 AS INTEGER) AS fold, CASE WHEN r = test THEN 'test' ELSE 'train' END AS role
        FROM t WHERE r = test OR (r >= {begin} AND r < test - {gap})""",
        "growth_q",
    )


def _folds(spark, d, gap, growing):
    frame = b.growth_q(spark, d).filter(F.col("y").isNotNull() & (F.col("period") <= CUT)).select("entity", "period", rounded(F.col("y")).alias("y"))
    return folds.fold_rows(frame, ["entity"], go_back=11, skip=2, gap=gap, growing=growing)


@query("q_cv_folds", _folds_sql(0, True))
def cv_folds(spark, d):
    return _folds(spark, d, 0, True)


@query("q_cv_folds_sliding", _folds_sql(3, False))
def cv_folds_sliding(spark, d):
    return _folds(spark, d, 3, False)


_LCG = "(({0})*1103515245 + 12345) % 2147483648"


def _draw(i: int) -> str:
    seed = f"(CAST(id AS BIGINT)*100003 + t*31 + {i * 7} + 12345) % 2147483648"
    return f"({_LCG.format(_LCG.format(seed))})/2147483648.0"


@query(
    "q_param_random",
    sql(
        f"""+s AS (SELECT entity, CAST(replace(entity, 'NATION_', '') AS BIGINT) AS id, CAST(count(value) AS DOUBLE) AS n FROM nation_q WHERE period <= {CUT} GROUP BY 1)
        SELECT entity, CAST(t AS INTEGER) AS trial, {r6(f'ceil(10 + {_draw(0)}*(1000 - 10))')} AS trees, {r6(f'ceil(18 + {_draw(1)}*(183 - 18))')} AS mtry,
               {r6(f'ceil(1 + {_draw(2)}*(floor(n/2) - 1))')} AS node_size, {r6(f'ceil(1 + {_draw(3)}*(10 - 1))')} AS depth, {r6(f'pow(10, -3 + {_draw(4)}*2)')} AS rate,
               {r6(f'pow(10, -2 + {_draw(5)}*6)')} AS cost, {r6(f'pow(10, -5 + {_draw(6)}*5)')} AS epsilon FROM s, range(0, 300) t(t)""",
        "nation_q",
    ),
)
def param_random(spark, d):
    """Three hundred candidates per series; the largest node is half of its training rows."""
    sizes = b.nation_q(spark, d).filter(F.col("period") <= CUT).groupBy("entity").agg(F.count("value").cast("double").alias("n"))
    params = {
        "trees": (10, 1000, "int"),
        "mtry": (18, 183, "int"),
        "node_size": (F.lit(1.0), F.floor(F.col("n") / 2), "int"),
        "depth": (1, 10, "int"),
        "rate": (-3, -1, "pow10"),
        "cost": (-2, 4, "pow10"),
        "epsilon": (-5, 0, "pow10"),
    }
    number = F.regexp_replace("entity", "NATION_", "")
    out = folds.random_candidates(sizes, "entity", number, params, 300)
    return out.select("entity", "trial", *[rounded(F.col(p)).alias(p) for p in params])


NPAR = 3
_BEST = "best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY learner ORDER BY rmse) AS r FROM trials) WHERE r <= 30)"


def best_trials(spark, d):
    return windows.top_with_ties(b.trials(spark, d), ["learner"], "rmse", 10 * NPAR)


def trial_bounds(best, params):
    """Quartiles of every parameter among the best trials, as the next search's bounds."""
    return aggregates.exact_percentiles_of(best, ["learner"], list(params), {"lo": 0.25, "hi": 0.75})


@query(
    "q_trial_summary",
    sql(
        f"""+{_BEST} SELECT learner, count(*) AS n, {r6('min(rmse)')} AS best_rmse, {r6('max(rmse)')} AS worst_rmse,
            {', '.join(f"{r6(f'quantile_cont({p}, 0.25)')} AS {p}_lo, {r6(f'quantile_cont({p}, 0.75)')} AS {p}_hi" for p in ('trees', 'rate', 'cost'))}
            FROM best GROUP BY 1""",
        "trials",
    ),
)
def trial_summary(spark, d):
    best = best_trials(spark, d)
    params = ("trees", "rate", "cost")
    counts = best.groupBy("learner").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.min("rmse")).alias("best_rmse"), rounded(F.max("rmse")).alias("worst_rmse")
    )
    bounds = trial_bounds(best, params).select("learner", *[rounded(F.col(f"{p}_{e}")).alias(f"{p}_{e}") for p in params for e in ("lo", "hi")])
    return counts.join(bounds, "learner")


@query(
    "q_param_grid",
    sql(
        f"""+{_BEST}, q AS (SELECT learner, {', '.join(f"quantile_cont({p}, 0.25) AS {p}_lo, quantile_cont({p}, 0.75) AS {p}_hi" for p in ('trees', 'rate', 'cost'))} FROM best GROUP BY 1)
        SELECT learner, CAST(c AS INTEGER) AS candidate, {r6('trees_lo + (trees_hi - trees_lo)*(c % 11)/10.0')} AS trees,
               {r6('rate_lo + (rate_hi - rate_lo)*((c // 11) % 11)/10.0')} AS rate, {r6('cost_lo + (cost_hi - cost_lo)*((c // 121) % 6)/5.0')} AS cost
        FROM q, range(0, 726) t(c)""",
        "trials",
    ),
)
def param_grid(spark, d):
    """The 11 x 11 x 6 grid between the quartiles of each learner's best trials."""
    bounds = trial_bounds(best_trials(spark, d), ("trees", "rate", "cost"))
    out = folds.grid_candidates(bounds, "learner", {"trees": 11, "rate": 11, "cost": 6})
    return out.select("learner", "candidate", *[rounded(F.col(c)).alias(c) for c in ("trees", "rate", "cost")])


@query(
    "q_cut",
    """SELECT c_custkey, CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN '(-1000,0]' WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN '(0,2500]'
              WHEN c_acctbal > 2500 AND c_acctbal <= 9000 THEN '(2500,9000]' END AS right_closed,
              CASE WHEN c_nationkey < 5 THEN '[-Inf,5)' WHEN c_nationkey < 10 THEN '[5,10)' WHEN c_nationkey < 24 THEN '[10,24)' END AS left_closed FROM customer""",
)
def cut(spark, d):
    return b.table(spark, d, "customer").select(
        "c_custkey",
        cut_label(F.col("c_acctbal"), [-1000, 0, 2500, 9000]).alias("right_closed"),
        cut_label(F.col("c_nationkey").cast("double"), [float("-inf"), 5, 10, 24], right=False).alias("left_closed"),
    )


