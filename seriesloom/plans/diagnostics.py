"""Queries on series diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.scalars import rounded
from seriesloom.operators import diagnostics as dg
from seriesloom.plans import bindings as b
from seriesloom.plans import sqltools as st
from seriesloom.plans.registry import query, r6, sql

_ACF = """c AS (SELECT entity, period, x - avg(x) OVER (PARTITION BY entity) AS d FROM event_h),
  a AS (SELECT entity, k, count(*) AS n_pairs, sum(d*dl) AS s FROM (
          SELECT entity, t.k, d, lag(d, t.k) OVER (PARTITION BY entity, t.k ORDER BY period) AS dl FROM c, range(1, 11) t(k)) WHERE dl IS NOT NULL GROUP BY 1, 2),
  z AS (SELECT entity, count(*) AS n, sum(d*d) AS s0 FROM c GROUP BY 1),
  acf AS (SELECT entity, CAST(k AS INTEGER) AS lag, n, s/nullif(s0, 0) AS r FROM a JOIN z USING (entity))"""


def _acf(spark, d):
    return dg.autocorrelations(b.event_h(spark, d), ["entity"], "x", 10)


@query("q_acf", sql(f"+{_ACF} SELECT entity, lag, n, {r6('r')} AS acf, {r6('1.959963984540054/sqrt(n)')} AS band FROM acf", "event_h"))
def acf(spark, d):
    rows = dg.acf_rows(_acf(spark, d), ["entity"])
    return rows.select("entity", "lag", "n", rounded(F.col("acf")).alias("acf"), rounded(F.col("band")).alias("band"))


@query(
    "q_pacf",
    sql(
        f"""+{_ACF}, l AS (SELECT entity, list(r ORDER BY lag) AS r FROM acf GROUP BY 1),
        dl AS (SELECT entity, r, 1 AS k, [r[1]] AS phi FROM l
               UNION ALL
               SELECT entity, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - a*phi[k + 1 - i]), a) FROM (
                 SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i]*r[k + 1 - i])))
                           /(1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i]*r[i]))) AS a FROM dl WHERE k < 10))
        SELECT entity, k AS lag, {r6('phi[k]')} AS pacf FROM dl""",
        "event_h",
        recursive=True,
    ),
)
def pacf(spark, d):
    arrays = _acf(spark, d).select("entity", dg.partial_autocorrelations("acf").alias("p"))
    rows = arrays.select("entity", F.posexplode("p").alias("i", "v"))
    return rows.select("entity", (F.col("i") + 1).alias("lag"), rounded(F.col("v")).alias("pacf"))


@query(
    "q_ljung_box",
    sql(
        f"""+{_ACF}, s AS (SELECT entity, n, n*(n + 2.0)*sum(r*r/(n - lag)) AS q, n*sum(r*r) AS b FROM acf GROUP BY 1, 2)
        SELECT entity, n, {r6('q')} AS ljung_box, {r6('b')} AS box_pierce,
               {r6('exp(-q/2)*(1 + q/2 + pow(q/2,2)/2 + pow(q/2,3)/6 + pow(q/2,4)/24)')} AS p_ljung_box,
               {r6('exp(-b/2)*(1 + b/2 + pow(b/2,2)/2 + pow(b/2,3)/6 + pow(b/2,4)/24)')} AS p_box_pierce FROM s""",
        "event_h",
    ),
)
def ljung_box(spark, d):
    out = dg.portmanteau(_acf(spark, d), ["entity"], 10)
    names = ("ljung_box", "box_pierce", "p_ljung_box", "p_box_pierce")
    return out.select("entity", "n", *[rounded(F.col(c)).alias(c) for c in names])


# the p-value table at each series' own size
_SIZE_POINTS = [f"({st.interpolate('size - 1', dg.ADF_P_SIZES, list(column))})" for column in zip(*dg.ADF_P_TABLE)]
_SRC = "src AS (SELECT entity, period, value/1e6 AS x, row_number() OVER (PARTITION BY entity ORDER BY period) AS t FROM nation_q WHERE value IS NOT NULL)"
_DIFF = """dif AS (SELECT *, x - lag(x) OVER w AS dy, lag(x) OVER w AS y1, count(*) OVER (PARTITION BY entity) AS size FROM src WINDOW w AS (PARTITION BY entity ORDER BY period)),
  lagd AS (SELECT *, lag(dy, 1) OVER w AS d1, lag(dy, 2) OVER w AS d2 FROM dif WINDOW w AS (PARTITION BY entity ORDER BY period))"""
_ADF_MODELS = {"none": ([3, 4], [5]), "drift": ([1, 3, 4], [5]), "trend": ([1, 2, 3, 4], [5]), "rd": ([4], [5]), "rt": ([1, 4], [5])}


def _critical_case(name: str, which: int) -> str:
    table = dg.ADF_CRITICAL[name]
    arms = " ".join(f"WHEN size - 1 < {size} THEN {row[which]}" for size, row in zip(dg.ADF_SIZES, table))
    return f"(CASE {arms} ELSE {table[-1][which]} END)"


def _bucket(stat: str, name: str, lower: bool) -> str:
    one, five, ten = (_critical_case(name, i) for i in range(3))
    lt, gt = ("<", ">") if lower else (">", "<")
    return (
        f"CASE WHEN {stat} IS NULL THEN NULL WHEN {stat} {lt} {ten} AND {stat} {gt} {five} THEN '<0.1' "
        f"WHEN {stat} {lt} {five} AND {stat} {gt} {one} THEN '<0.05' WHEN {stat} {lt} {one} THEN '<0.01' ELSE '>0.1' END"
    )


def _model_value(model: str, expression: str) -> str:
    return f"max(CASE WHEN model = '{model}' THEN {expression} END)"


_ADF = f"""{_SRC}, {_DIFF},
  {st.moments_cte('mom', '(SELECT * FROM lagd WHERE d1 IS NOT NULL)', ['entity', 'size'], ['1.0', 't/10.0', 'y1', 'd1', 'dy'])},
  {st.solve_ctes('mom', ['entity', 'size'], _ADF_MODELS)},
  r AS (SELECT entity, size, max(n) AS n, {', '.join(f"{_model_value(k, st.rss(x, 5))} AS rss_{k}" for k, (x, _) in _ADF_MODELS.items())},
        {_model_value('none', st.beta(1, 2))} AS b1, {_model_value('none', st.inverse(1, 2))} AS v1,
        {_model_value('trend', st.beta(3, 4))} AS b3, {_model_value('trend', st.inverse(3, 4))} AS v3 FROM sol GROUP BY 1, 2),
  adf AS (SELECT entity, size, b1/sqrt(rss_none/(n - 2)*v1) AS tau1, ((rss_rd - rss_drift)/2)/(rss_drift/(n - 3)) AS phi1,
        ((rss_rt - rss_trend)/2)/(rss_trend/(n - 4)) AS phi3, b3/sqrt(rss_trend/(n - 4)*v3) AS tau3 FROM r),
  adfb AS (SELECT *, {_bucket('tau1', 'tau1', True)} AS p_none, {_bucket('phi1', 'phi1', False)} AS p_drift, {_bucket('phi3', 'phi3', False)} AS p_trend FROM adf)"""


def _levels(spark, d):
    return b.nation_q(spark, d).select("entity", "period", (F.col("value") / 1e6).alias("x"))


@query(
    "q_adf",
    sql(
        f"""+{_ADF} SELECT entity, size, {r6('tau1')} AS tau1, {r6('phi1')} AS phi1, {r6('phi3')} AS phi3, {r6('tau3')} AS tau3, p_none, p_drift, p_trend FROM adfb""",
        "nation_q",
        recursive=True,
    ),
)
def adf(spark, d):
    out = dg.adf_tests(_levels(spark, d), ["entity"], "x", 1)
    return out.select("entity", "size", *[rounded(F.col(c)).alias(c) for c in ("tau1", "phi1", "phi3", "tau3")], "p_none", "p_drift", "p_trend")


# the same rows for both orders; a restricted model takes the order of its full one
_BIC_ORDERS = {k: {model: ([c for c in x if c <= 3 + k], [6]) for model, x in {
    "none": [3, 4, 5], "drift": [1, 3, 4, 5], "trend": [1, 2, 3, 4, 5], "rd": [4, 5], "rt": [1, 4, 5]}.items()} for k in (1, 2)}
_BIC_MODELS = {f"{model}{k}": columns for k, models in _BIC_ORDERS.items() for model, columns in models.items()}


def _bic(model: str, k: int) -> str:
    return f"(n*ln(rss_{model}{k}/n) + {len(_BIC_MODELS[f'{model}{k}'][0])}*ln(n))"


def _of_order(model: str, expression: str) -> str:
    """The expression, with # for the order, at the order of the model."""
    return f"CASE k_{model} WHEN 1 THEN {expression.replace('#', '1')} ELSE {expression.replace('#', '2')} END"


_ADF_BIC = f"""{_SRC}, {_DIFF},
  {st.moments_cte('momb', '(SELECT * FROM lagd WHERE d2 IS NOT NULL)', ['entity', 'size'], ['1.0', 't/10.0', 'y1', 'd1', 'd2', 'dy'])},
  {st.solve_ctes('momb', ['entity', 'size'], _BIC_MODELS, 'b')},
  rb AS (SELECT entity, size, max(n) AS n, {', '.join(f"{_model_value(k, st.rss(x, 6))} AS rss_{k}" for k, (x, _) in _BIC_MODELS.items())},
        {', '.join(f"{_model_value(f'none{k}', st.beta(1, 1 + k))} AS b{k}, {_model_value(f'none{k}', st.inverse(1, 1 + k))} AS v{k}" for k in (1, 2))} FROM solb GROUP BY 1, 2),
  kb AS (SELECT *, {', '.join(f"CASE WHEN {_bic(m, 2)} < {_bic(m, 1)} THEN 2 ELSE 1 END AS k_{m}" for m in ('none', 'drift', 'trend'))} FROM rb),
  sb AS (SELECT entity, size, k_none, k_drift, k_trend, {_of_order('none', 'b#/sqrt(rss_none#/(n - 1 - #)*v#)')} AS tau1,
        {_of_order('drift', '((rss_rd# - rss_drift#)/2)/(rss_drift#/(n - 2 - #))')} AS phi1,
        {_of_order('trend', '((rss_rt# - rss_trend#)/2)/(rss_trend#/(n - 3 - #))')} AS phi3 FROM kb),
  bb AS (SELECT *, {_bucket('tau1', 'tau1', True)} AS p_none, {_bucket('phi1', 'phi1', False)} AS p_drift, {_bucket('phi3', 'phi3', False)} AS p_trend FROM sb)"""


@query(
    "q_adf_bic",
    sql(
        f"""+{_ADF_BIC} SELECT entity, size, k_none, k_drift, k_trend, {r6('tau1')} AS tau1, {r6('phi1')} AS phi1, {r6('phi3')} AS phi3, p_none, p_drift, p_trend FROM bb""",
        "nation_q",
        recursive=True,
    ),
)
def adf_bic(spark, d):
    """Lag order of each model by BIC, up to two."""
    out = dg.adf_tests(_levels(spark, d), ["entity"], "x", max_lags=2)
    stats = [rounded(F.col(c)).alias(c) for c in ("tau1", "phi1", "phi3")]
    return out.select("entity", "size", "k_none", "k_drift", "k_trend", *stats, "p_none", "p_drift", "p_trend")


_ADF_P = f"""ordered AS (SELECT *, CAST(floor(pow(size - 1.0, 1/3.0) + 1e-9) AS INTEGER) AS ord FROM lagd),
  {st.moments_cte('momp', '(SELECT * FROM ordered WHERE t > ord + 1 AND ord = 2)', ['entity', 'size', 'ord'], ['1.0', 't/10.0', 'y1', 'd1', 'd2', 'dy'])},
  {st.moments_cte('momq', '(SELECT * FROM ordered WHERE t > ord + 1 AND ord = 1)', ['entity', 'size', 'ord'], ['1.0', 't/10.0', 'y1', 'd1', 'dy'])},
  {st.solve_ctes('momp', ['entity', 'size', 'ord'], {'two': ([1, 2, 3, 4, 5], [6])}, 'p')},
  {st.solve_ctes('momq', ['entity', 'size', 'ord'], {'one': ([1, 2, 3, 4], [5])}, 'q')},
  stat AS (SELECT entity, size, ord, {st.beta(3, 5)}/sqrt({st.rss([1, 2, 3, 4, 5], 6)}/(n - 5)*{st.inverse(3, 5)}) AS statistic FROM solp
           UNION ALL SELECT entity, size, ord, {st.beta(3, 4)}/sqrt({st.rss([1, 2, 3, 4], 5)}/(n - 4)*{st.inverse(3, 4)}) FROM solq),
  adfp AS (SELECT *, {st.interpolate('statistic', _SIZE_POINTS, dg.ADF_P_LEVELS)} AS p_value FROM stat)"""


@query(
    "q_adf_p",
    sql(
        f"""+{_SRC}, {_DIFF}, {_ADF_P} SELECT entity, ord AS k, {r6('statistic')} AS statistic, {r6('p_value')} AS p_value FROM adfp""",
        "nation_q",
        recursive=True,
    ),
)
def adf_p(spark, d):
    out = dg.adf_trend_p(_levels(spark, d), ["entity"], "x")
    return out.select("entity", "k", rounded(F.col("statistic")).alias("statistic"), rounded(F.col("p_value")).alias("p_value"))


_LONG_LAGS = 8  # whole cube root of 719
_LONG_X = list(range(1, 4 + _LONG_LAGS))


@query(
    "q_adf_long",
    sql(
        f"""+s AS (SELECT entity, period, x, row_number() OVER w AS t, x - lag(x) OVER w AS dy, lag(x) OVER w AS y1 FROM event_h WINDOW w AS (PARTITION BY entity ORDER BY period)),
        l AS (SELECT *, {', '.join(f'lag(dy, {k}) OVER w AS d{k}' for k in range(1, _LONG_LAGS + 1))} FROM s WINDOW w AS (PARTITION BY entity ORDER BY period)),
        {st.moments_cte('mom', f'(SELECT * FROM l WHERE d{_LONG_LAGS} IS NOT NULL)', ['entity'], ['1.0', 't/100.0', 'y1', *[f'd{k}' for k in range(1, _LONG_LAGS + 1)], 'dy'])},
        {st.solve_ctes('mom', ['entity'], {'trend': (_LONG_X, [len(_LONG_X) + 1])})},
        r AS (SELECT entity, n + {_LONG_LAGS} + 1 AS size, {st.beta(3, len(_LONG_X))}/sqrt({st.rss(_LONG_X, len(_LONG_X) + 1)}/(n - {len(_LONG_X)})*{st.inverse(3, len(_LONG_X))}) AS statistic FROM sol)
        SELECT entity, {_LONG_LAGS} AS k, {r6('statistic')} AS statistic, {r6(st.interpolate('statistic', _SIZE_POINTS, dg.ADF_P_LEVELS))} AS p_value FROM r""",
        "event_h",
        recursive=True,
    ),
)
def adf_long(spark, d):
    """Long hourly series: lag order eight, p-values interpolated over sample sizes."""
    out = dg.adf_trend_p(b.event_h(spark, d), ["entity"], "x")
    return out.select("entity", "k", rounded(F.col("statistic")).alias("statistic"), rounded(F.col("p_value")).alias("p_value"))


@query(
    "q_adf_no_lags",
    sql(
        f"""+p AS (SELECT entity, period, x - lag(x) OVER w AS dy, lag(x) OVER w AS y1 FROM event_h WINDOW w AS (PARTITION BY entity ORDER BY period)),
        m AS (SELECT entity, count(dy) AS n, regr_slope(dy, y1) AS b, regr_intercept(dy, y1) AS a, regr_sxx(dy, y1) AS sxx,
                     regr_syy(dy, y1)*(1 - regr_r2(dy, y1)) AS rss, sum(dy*dy) AS s0, sum(dy*y1) AS sxy, sum(CASE WHEN dy IS NOT NULL THEN y1*y1 END) AS xx FROM p WHERE dy IS NOT NULL GROUP BY 1)
        SELECT entity, n + 1 AS size, {r6('(sxy/xx)/sqrt((s0 - sxy*sxy/xx)/(n - 1)/xx)')} AS tau1, {r6('((s0 - rss)/2)/(rss/(n - 2))')} AS phi1 FROM m""",
        "event_h",
    ),
)
def adf_no_lags(spark, d):
    out = dg.adf_tests(b.event_h(spark, d), ["entity"], "x", 0)
    return out.select("entity", "size", rounded(F.col("tau1")).alias("tau1"), rounded(F.col("phi1")).alias("phi1"))


def _interp(s: str, crit: list[float]) -> str:
    ps = dg.KPSS_LEVELS
    arms = [f"WHEN {s} <= {crit[0]} THEN {ps[0]}"]
    for a, c, p, q in zip(crit, crit[1:], ps, ps[1:]):
        arms.append(f"WHEN {s} < {c} THEN {p} + ({s} - {a})/({c} - {a})*({q} - {p})")
    return f"CASE {' '.join(arms)} ELSE {ps[-1]} END"


_KPSS = """kr AS (SELECT entity, period, x, CAST(row_number() OVER (PARTITION BY entity ORDER BY period) AS DOUBLE) AS t FROM {source}),
  e AS (SELECT entity, period, x - avg(x) OVER p AS el, x - (regr_intercept(x, t) OVER p + (regr_slope(x, t) OVER p)*t) AS et, count(*) OVER p AS n
        FROM kr WINDOW p AS (PARTITION BY entity)),
  c AS (SELECT *, floor(4*pow(n/100.0, 0.25) + 1e-9) AS l, sum(el) OVER w AS sl, sum(et) OVER w AS st FROM e
        WINDOW w AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT entity, k, sum(el*ll)*(1 - k/(max(l) + 1)) AS gl, sum(et*lt)*(1 - k/(max(l) + 1)) AS gt FROM (
          SELECT entity, t.k, el, et, l, lag(el, t.k) OVER v AS ll, lag(et, t.k) OVER v AS lt FROM c, range(1, 30) t(k) WINDOW v AS (PARTITION BY entity, t.k ORDER BY period))
        WHERE k <= l GROUP BY 1, 2),
  q AS (SELECT entity, max(n) AS n, sum(sl*sl) AS sl2, sum(st*st) AS st2, sum(el*el) AS v0l, sum(et*et) AS v0t FROM c GROUP BY 1),
  k AS (SELECT q.entity, n, sl2/(n*n*((v0l + 2*g1)/n)) AS level, st2/(n*n*((v0t + 2*g2)/n)) AS trend FROM q
        JOIN (SELECT entity, sum(gl) AS g1, sum(gt) AS g2 FROM g GROUP BY 1) s ON s.entity = q.entity)"""


@query(
    "q_kpss",
    sql(
        f"""+{_KPSS.format(source='event_h')} SELECT entity, n, {r6('level')} AS level, {r6('trend')} AS trend, {r6(_interp('level', dg.KPSS_CRITICAL['level']))} AS p_level,
            {r6(_interp('trend', dg.KPSS_CRITICAL['trend']))} AS p_trend FROM k""",
        "event_h",
    ),
)
def kpss(spark, d):
    out = dg.kpss_tests(b.event_h(spark, d), ["entity"], "x")
    return out.select("entity", "n", *[rounded(F.col(c)).alias(c) for c in ("level", "trend", "p_level", "p_trend")])


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 WHEN NOT ({condition}) THEN 0 END"


_VOTES = {
    "adf_none": "p_none IN ('<0.1', '>0.1')",
    "adf_drift": "p_drift IN ('<0.1', '>0.1')",
    "adf_trend1": "p_trend IN ('<0.1', '>0.1')",
    "adf_trend2": "p_value > 0.05",
    "kpss_level": f"{_interp('level', dg.KPSS_CRITICAL['level'])} < 0.05",
    "kpss_trend": f"{_interp('trend', dg.KPSS_CRITICAL['trend'])} < 0.05",
}


@query(
    "q_stationarity_vote",
    sql(
        f"""+{_ADF}, {_ADF_P}, {_KPSS.format(source='src')},
        v AS (SELECT adfb.entity, {', '.join(f"{_flag(c)} AS {name}" for name, c in _VOTES.items())} FROM adfb JOIN adfp ON adfp.entity = adfb.entity JOIN k ON k.entity = adfb.entity)
        SELECT *, {' + '.join(dg.VERDICTS)} AS total, {' + '.join(dg.TREND_VERDICTS)} AS total_trend, {' + '.join(dg.LEVEL_VERDICTS)} AS total_level FROM v""",
        "nation_q",
        recursive=True,
    ),
)
def stationarity_vote(spark, d):
    panel = _levels(spark, d)
    votes = dg.verdicts(
        dg.adf_tests(panel, ["entity"], "x", 1),
        dg.adf_trend_p(panel, ["entity"], "x"),
        dg.kpss_tests(panel, ["entity"], "x"),
        ["entity"],
    )
    return dg.stationarity_vote(votes)


@query(
    "q_granger_pair",
    sql(
        f"""+f AS (SELECT entity, period, 100.0*(revenue/lag(revenue) OVER w - 1.0) AS y, quantity AS q, discount*100 AS disc FROM flag_m
                  WINDOW w AS (PARTITION BY entity ORDER BY period)),
        u AS (SELECT entity, period, y, lag(y) OVER w AS y1, lag(q) OVER w AS q1, lag(disc) OVER w AS d1 FROM f WINDOW w AS (PARTITION BY entity ORDER BY period)),
        v AS (SELECT entity, 'q' AS series, y, y1, q1 AS x1 FROM u UNION ALL SELECT entity, 'disc', y, y1, d1 FROM u),
        m AS (SELECT entity, series, CAST(count(*) AS DOUBLE) AS n, regr_syy(y, y1) AS syy, regr_sxx(y, y1) AS s11, regr_sxx(y, x1) AS s22,
                     regr_sxy(y, y1) AS s1y, regr_sxy(y, x1) AS s2y, regr_sxy(x1, y1) AS s12
              FROM v WHERE y IS NOT NULL AND y1 IS NOT NULL AND x1 IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT *, syy - s1y*s1y/s11 AS rss0, syy - (s1y*(s1y*s22 - s2y*s12) + s2y*(s2y*s11 - s1y*s12))/(s11*s22 - s12*s12) AS rss1 FROM m)
        SELECT entity, series, n, {r6('(rss0 - rss1)/(rss1/(n - 3))')} AS f_stat FROM s""",
        "flag_m",
    ),
)
def granger_pair(spark, d):
    out = dg.granger_pairs(b.flag_features(spark, d), ["entity"], "y", ["q", "disc"], 1)
    return out.select("entity", "series", "n", rounded(F.col("f_stat")).alias("f_stat"))


_NAMES = ["y", "q", "disc", "tax", "gn"]
FLAGS = """feat AS (SELECT entity, period, 100.0*(revenue/nullif(lag(revenue) OVER w, 0) - 1.0) AS y, quantity - 25 AS q, discount*100 - 5 AS disc, tax*100 - 4 AS tax,
    100.0*(n/nullif(CAST(lag(n) OVER w AS DOUBLE), 0) - 1.0) AS gn FROM flag_m WINDOW w AS (PARTITION BY entity ORDER BY period))"""
_LAGGED = f"""{FLAGS}, lagged AS (SELECT entity, period, {', '.join(_NAMES)}, {', '.join(f'lag({c}, {k}) OVER w AS {c}{k}' for c in _NAMES for k in (1, 2))}
    FROM feat WINDOW w AS (PARTITION BY entity ORDER BY period))"""


def _f_sql(less: str, full: str, q: int, df: str) -> str:
    return f"(({less} - {full})/{q})/({full}/{df})"


def _pair_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT entity, '{c}' AS series, y, y1, y2, {c}1 AS x1, {c}2 AS x2 FROM lagged WHERE y IS NOT NULL AND y2 IS NOT NULL AND {c}2 IS NOT NULL" for c in _NAMES[1:]
    )
    base, full = [1, 2, 3], [1, 2, 3, 4, 5]
    return f"""+{_LAGGED}, pairs AS ({parts}),
      {st.moments_cte('mom', 'pairs', ['entity', 'series'], ['1.0', 'y1', 'y2', 'x1', 'x2', 'y'])},
      {st.solve_ctes('mom', ['entity', 'series'], {'base': (base, [6]), 'full': (full, [6])})},
      r AS (SELECT entity, series, max(n) AS n, {_model_value('base', st.rss(base, 6))} AS r0, {_model_value('full', st.rss(full, 6))} AS r1 FROM sol GROUP BY 1, 2),
      f AS (SELECT entity, series, n, {_f_sql('r0', 'r1', 2, '(n - 5)')} AS f FROM r)
      SELECT entity, series, n, {r6('f')} AS f_stat, {r6('pow(1 + 2*f/(n - 5), -(n - 5)/2)')} AS p_value FROM f"""


@query("q_granger_pair_lags", sql(_pair_sql(), "flag_m", recursive=True))
def granger_pair_lags(spark, d):
    """Two lags: an F law with two numerator degrees of freedom has a closed tail for the SQL."""
    out = dg.granger_pairs(b.flag_features(spark, d), ["entity"], "y", _NAMES[1:], 2)
    return out.select("entity", "series", "n", rounded(F.col("f_stat")).alias("f_stat"), rounded(F.col("p_value")).alias("p_value"))


def _stepwise_sql() -> str:
    z = ["1.0", *[f"{c}{k}" for c in _NAMES for k in (1, 2)], "y"]
    everything = list(range(1, 12))
    models = {"full": (everything, [12])}
    for i, c in enumerate(_NAMES[1:], 1):
        models[c] = ([j for j in everything if j not in (2 + 2 * i, 3 + 2 * i)], [12])
    rows = " UNION ALL ".join(
        f"SELECT entity, '{c}' AS series, max(n) AS n, {_model_value(c, st.rss(models[c][0], 12))} AS r0, {_model_value('full', st.rss(everything, 12))} AS r1 FROM sol GROUP BY 1"
        for c in _NAMES[1:]
    )
    return f"""+{_LAGGED}, {st.moments_cte('mom', '(SELECT * FROM lagged WHERE y IS NOT NULL AND y2 IS NOT NULL AND gn2 IS NOT NULL)', ['entity'], z)},
      {st.solve_ctes('mom', ['entity'], models)}, r AS ({rows}), f AS (SELECT *, {_f_sql('r0', 'r1', 2, '(n - 11)')} AS f FROM r)
      SELECT entity, series, n, {r6('f')} AS f_stat, {r6('pow(1 + 2*f/(n - 11), -(n - 11)/2)')} AS p_value FROM f"""


@query("q_granger_stepwise", sql(_stepwise_sql(), "flag_m", recursive=True))
def granger_stepwise(spark, d):
    out = dg.granger_stepwise(b.flag_features(spark, d), ["entity"], "y", _NAMES[1:], 2)
    return out.select("entity", "series", "n", rounded(F.col("f_stat")).alias("f_stat"), rounded(F.col("p_value")).alias("p_value"))
