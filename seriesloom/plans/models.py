"""Queries on systems, ARMA models and factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.scalars import rounded
from seriesloom.operators import arma, baselines, evaluate, factors, joins, systems
from seriesloom.operators.ordering import bind_rows
from seriesloom.plans import bindings as b
from seriesloom.plans import sqltools as st
from seriesloom.plans.diagnostics import FLAGS
from seriesloom.plans.registry import CUT, LAST_QUARTER, LAST_SHIPPED, query, r6, sql
from seriesloom.sources import literals
from seriesloom.sources.panels import stage

MONTH_CUT = 24000  # 2000-01
NK = ["y", "q", "disc"]
LI = ["y", "q", "disc", "tax", "gn"]
LEVELS = ["revenue", "quantity", "discount"]
LAGS = list(range(10, 51, 5))


@query("q_var_backtest")
def var_backtest(spark, d):
    panel = b.flag_features(spark, d)
    small = systems.var_backtest(panel, ["entity"], NK, 2, "VAR_NK", MONTH_CUT, b.ship_months(spark, d)[1])
    return small.unionByName(systems.var_backtest(panel, ["entity"], LI, 1, "VAR_LI", MONTH_CUT, b.ship_months(spark, d)[1]))


@query(
    "q_var_univariate",
    sql(
        f"""+v AS (SELECT entity, period AS o, y, regr_slope(y, yl) OVER e AS b, regr_intercept(y, yl) OVER e AS c, regr_count(y, yl) OVER e AS n,
                   (regr_syy(y, yl) OVER e)*(1.0 - regr_r2(y, yl) OVER e)/nullif(regr_count(y, yl) OVER e - 2, 0) AS v, lead(y) OVER w AS t1
            FROM (SELECT entity, period, y, lag(y) OVER (PARTITION BY entity ORDER BY period) AS yl FROM growth_q)
            WINDOW w AS (PARTITION BY entity ORDER BY period), e AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING))
        SELECT entity, CAST(o + 1 AS INTEGER) AS forecast_period, {r6('c + b*y')} AS mean, {r6('c + b*y - 1.959963984540054*sqrt(v)')} AS lower,
               {r6('t1 - (c + b*y)')} AS error FROM v WHERE o + 1 BETWEEN {CUT + 1} AND {LAST_QUARTER}""",
        "growth_q",
    ),
)
def var_univariate(spark, d):
    """The system code on one variable, where SQL can follow it."""
    out = systems.var_backtest(b.growth_q(spark, d), ["entity"], ["y"], 1, "VAR", CUT, b.quarters(spark, d)[1], (1,))
    return out.select("entity", "forecast_period", *[rounded(F.col(c)).alias(c) for c in ("mean", "lower", "error")])


_Z = ["1.0", *[f"{c}{k}" for k in (1, 2) for c in NK], *NK]
_TERMS = ["const", *[f"{c}_l{k}" for k in (1, 2) for c in NK]]
_NK_LAGS = f"""{FLAGS}, lagged AS (SELECT entity, period, {', '.join(NK)}, {', '.join(f'lag({c}, {k}) OVER w AS {c}{k}' for c in NK for k in (1, 2))},
    lead(y, 1) OVER w AS t1, lead(y, 4) OVER w AS t4 FROM feat WINDOW w AS (PARTITION BY entity ORDER BY period))"""
_X = list(range(1, 8))


def _coef_sql() -> str:
    parts = []
    for e, name in enumerate(NK):
        y = 8 + e
        for r, term in enumerate(_TERMS, 1):
            parts.append(
                f"SELECT entity, '{name}' AS equation, '{term}' AS term, n, {st.beta(r, 7, e)} AS b, {st.inverse(r, 7, 3)} AS v, {st.rss(_X, y, e)} AS rss, "
                f"m[{y}][{y}] - m[1][{y}]*m[1][{y}]/n AS tss FROM sol"
            )
    return f"""+{_NK_LAGS}, {st.moments_cte('mom', '(SELECT * FROM lagged WHERE y IS NOT NULL AND y2 IS NOT NULL AND q2 IS NOT NULL)', ['entity'], _Z)},
      {st.solve_ctes('mom', ['entity'], {'var': (_X, [8, 9, 10])})}, c AS ({' UNION ALL '.join(parts)})
      SELECT entity, equation, term, n, {r6('b')} AS estimate, {r6('sqrt(rss/(n - 7)*v)')} AS std_error, {r6('b/sqrt(rss/(n - 7)*v)')} AS t_value,
             {r6('1 - rss/tss')} AS r2, {r6('1 - rss/tss*(n - 1)/(n - 7)')} AS adj_r2, {r6('((1 - rss/tss)/6)/((rss/tss)/(n - 7))')} AS f_stat FROM c"""


@query("q_coef_table", sql(_coef_sql(), "flag_m", recursive=True))
def coef_table(spark, d):
    out = systems.coefficient_table(b.flag_features(spark, d), ["entity"], NK, 2)
    names = ("estimate", "std_error", "t_value", "r2", "adj_r2", "f_stat")
    return out.select("entity", "equation", "term", "n", *[rounded(F.col(c)).alias(c) for c in names])


def _coef_p_sql() -> str:
    lags = [f"{c}1" for c in LI]
    x = list(range(1, len(LI) + 2))
    parts = []
    for e, name in enumerate(LI):
        y = len(x) + 1 + e
        for r, term in enumerate(["const", *[f"{c}_l1" for c in LI]], 1):
            t = f"{st.beta(r, len(x), e)}/sqrt({st.rss(x, y, e)}/(n - {len(x)})*{st.inverse(r, len(x), len(LI))})"
            parts.append(f"SELECT entity, '{name}' AS equation, '{term}' AS term, n, {t} AS t FROM sol")
    return f"""+{FLAGS}, lagged AS (SELECT entity, {', '.join(LI)}, {', '.join(f'lag({c}) OVER w AS {c}1' for c in LI)} FROM feat WINDOW w AS (PARTITION BY entity ORDER BY period)),
      {st.moments_cte('mom', '(SELECT * FROM lagged WHERE y1 IS NOT NULL AND gn1 IS NOT NULL)', ['entity'], ['1.0', *lags, *LI])},
      {st.solve_ctes('mom', ['entity'], {'var': (x, [len(x) + 1 + e for e in range(len(LI))])})}, c AS ({' UNION ALL '.join(parts)})
      SELECT entity, equation, term, {r6('t')} AS t_value, {r6('2*(' + st.t_tail('abs(t)', f'(n - {len(x)})') + ')')} AS p_value FROM c"""


@query("q_coef_pvalues", sql(_coef_p_sql(), "flag_m", recursive=True))
def coef_pvalues(spark, d):
    out = systems.coefficient_table(b.flag_features(spark, d), ["entity"], LI, 1)
    return out.select("entity", "equation", "term", rounded(F.col("t_value")).alias("t_value"), rounded(F.col("p_value")).alias("p_value"))


def _var_sql() -> str:
    complete = "y IS NOT NULL AND y2 IS NOT NULL AND q2 IS NOT NULL"
    sums = ", ".join(
        "[" + ", ".join(f"sum(CASE WHEN {complete} THEN ({a})*({c}) END) OVER e" for c in _Z) + "]" for a in _Z
    )
    states = {0: list(NK), -1: [f"{c}1" for c in NK]}
    steps = []
    for h in range(1, 5):
        source = "sol JOIN lagged l ON l.entity = sol.entity AND l.period = o" if h == 1 else f"step{h - 1} s"
        now = [f"l.{c}" for c in states[0]] if h == 1 else [f"f{h - 1}_{c}" for c in NK]
        before = [f"l.{c}" for c in states[-1]] if h == 1 else [f"l_{c}" for c in NK] if h == 2 else [f"f{h - 2}_{c}" for c in NK]
        cols = []
        for e, name in enumerate(NK):
            terms = [st.beta(1, 7, e)] + [f"{st.beta(2 + i, 7, e)}*{v}" for i, v in enumerate([*now, *before])]
            cols.append(f"{' + '.join(terms)} AS f{h}_{name}")
        carry = "sol.entity, o, a, l.t1, l.t4, " + ", ".join(f"l.{c} AS l_{c}" for c in NK) if h == 1 else "s.*"
        steps.append(f"step{h} AS (SELECT {carry}, {', '.join(cols)} FROM {source})")
    return f"""+{_NK_LAGS}, mom AS (SELECT entity, period AS o, sum(CASE WHEN {complete} THEN 1.0 END) OVER e AS n, [{sums}] AS m FROM lagged
        WINDOW e AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING)),
      want AS (SELECT * FROM mom WHERE o BETWEEN {MONTH_CUT - 3} AND {LAST_SHIPPED} - 1),
      {st.solve_ctes('want', ['entity', 'o'], {'var': (_X, [8, 9, 10])})}, {', '.join(steps)}
      SELECT entity, 'VAR_NK_Q' AS model_id, CAST(o + 1 AS INTEGER) AS forecast_period, {r6('f1_y')} AS mean, {r6('t1 - f1_y')} AS error FROM step4 WHERE o + 1 > {MONTH_CUT}
      UNION ALL SELECT entity, 'VAR_NK_Y', CAST(o + 4 AS INTEGER), {r6('f4_y')}, {r6('t4 - f4_y')} FROM step4 WHERE o + 4 BETWEEN {MONTH_CUT + 1} AND {LAST_SHIPPED}"""


@query("q_var_forecast", sql(_var_sql(), "flag_m", recursive=True))
def var_forecast(spark, d):
    """Iterated forecasts of the three-variable system at every origin."""
    out = systems.var_backtest(b.flag_features(spark, d), ["entity"], NK, 2, "VAR_NK", MONTH_CUT, b.ship_months(spark, d)[1])
    return out.select("entity", "model_id", "forecast_period", rounded(F.col("mean")).alias("mean"), rounded(F.col("error")).alias("error"))


@query(
    "q_coef_table_simple",
    sql(
        f"""+p AS (SELECT entity, y, lag(y) OVER (PARTITION BY entity ORDER BY period) AS x FROM growth_q),
        m AS (SELECT entity, CAST(regr_count(y, x) AS DOUBLE) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx,
                     regr_avgx(y, x) AS mx, regr_syy(y, x)*(1 - regr_r2(y, x))/(regr_count(y, x) - 2) AS s2 FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
        SELECT entity, 'y_l1' AS term, {r6('b')} AS estimate, {r6('sqrt(s2/sxx)')} AS std_error, {r6('b/sqrt(s2/sxx)')} AS t_value, {r6('r2')} AS r2,
               {r6('1 - (1 - r2)*(n - 1)/(n - 2)')} AS adj_r2, {r6('r2/((1 - r2)/(n - 2))')} AS f_stat FROM m
        UNION ALL SELECT entity, 'const', {r6('a')}, {r6('sqrt(s2*(1/n + mx*mx/sxx))')}, {r6('a/sqrt(s2*(1/n + mx*mx/sxx))')}, {r6('r2')},
               {r6('1 - (1 - r2)*(n - 1)/(n - 2)')}, {r6('r2/((1 - r2)/(n - 2))')} FROM m""",
        "growth_q",
    ),
)
def coef_table_simple(spark, d):
    out = systems.coefficient_table(b.growth_q(spark, d), ["entity"], ["y"], 1)
    names = ("estimate", "std_error", "t_value", "r2", "adj_r2", "f_stat")
    return out.select("entity", "term", *[rounded(F.col(c)).alias(c) for c in names])


@query("q_granger_joint")
def granger_joint(spark, d):
    return systems.causality_tests(b.flag_features(spark, d), ["entity"], NK, 2)


@query("q_portmanteau")
def portmanteau(spark, d):
    return systems.system_portmanteau(b.flag_features(spark, d), ["entity"], NK, 2, LAGS)


@query(
    "q_var_order_univariate",
    sql(
        f"""+p AS (SELECT entity, y, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(y, 3) OVER w AS y3 FROM growth_q WINDOW w AS (PARTITION BY entity ORDER BY period)),
        {st.moments_cte('mom', '(SELECT * FROM p WHERE y IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL)', ['entity'], ['1.0', 'y1', 'y2', 'y3', 'y'])},
        {st.solve_ctes('mom', ['entity'], {'1': ([1, 2], [5]), '2': ([1, 2, 3], [5]), '3': ([1, 2, 3, 4], [5])})},
        r AS (SELECT entity, CAST(model AS INTEGER) AS p, n, CASE model WHEN '1' THEN {st.rss([1, 2], 5)} WHEN '2' THEN {st.rss([1, 2, 3], 5)} ELSE {st.rss([1, 2, 3, 4], 5)} END AS rss FROM sol)
        SELECT entity, p, {r6('ln(rss/n) + 2*p/n')} AS aic, {r6('ln(rss/n) + 2*ln(ln(n))*p/n')} AS hq, {r6('ln(rss/n) + ln(n)*p/n')} AS sc,
               arg_min(p, ln(rss/n) + ln(n)*p/n) OVER (PARTITION BY entity) AS best_sc FROM r WHERE n > p + 1""",
        "growth_q",
        recursive=True,
    ),
)
def var_order_univariate(spark, d):
    out = systems.var_order(b.growth_q(spark, d), ["entity"], ["y"], 3)
    return out.select("entity", "p", *[rounded(F.col(c)).alias(c) for c in ("aic", "hq", "sc")], "best_sc")


_AR_RESIDUALS = """u AS (SELECT entity, period, x - (regr_intercept(x, p) OVER e + (regr_slope(x, p) OVER e)*p) AS u FROM
    (SELECT *, lag(x) OVER (PARTITION BY entity ORDER BY period) AS p FROM event_h) WINDOW e AS (PARTITION BY entity) QUALIFY p IS NOT NULL),
  c AS (SELECT entity, j, sum(u*ul) AS c FROM (SELECT entity, j, u, lag(u, j) OVER (PARTITION BY entity, j ORDER BY period) AS ul FROM u, range(1, 16) t(j)) GROUP BY 1, 2),
  z AS (SELECT entity, CAST(count(*) AS DOUBLE) AS n, sum(u*u) AS c0 FROM u GROUP BY 1)"""


@query(
    "q_portmanteau_univariate",
    sql(
        f"""+{_AR_RESIDUALS} SELECT entity, CAST(h AS INTEGER) AS lags, CAST(h - 1 AS DOUBLE) AS df, {r6('n*sum(c*c)/(c0*c0)')} AS box_pierce,
               {r6('n*(n + 2)*sum(c*c/(n - j))/(c0*c0)')} AS ljung_box, {r6('n*n*sum(c*c/(n - j))/(c0*c0)')} AS hosking
        FROM (VALUES (10), (15)) t(h), c JOIN z USING (entity) WHERE j <= h GROUP BY entity, h, n, c0""",
        "event_h",
    ),
)
def portmanteau_univariate(spark, d):
    out = systems.system_portmanteau(b.event_h(spark, d), ["entity"], ["x"], 1, [10, 15])
    return out.select("entity", "lags", "df", *[rounded(F.col(c)).alias(c) for c in ("box_pierce", "ljung_box", "hosking")])


def _johansen_sql() -> str:
    def s(i: int, j: int) -> str:
        """Residual cross moment of z columns i and j given columns 1..3."""
        terms = " - ".join(f"{st.beta(r, 3, i - 4)}*m[{r}][{j}]" for r in (1, 2, 3))
        return f"(m[{i}][{j}] - {terms})"

    cells = ", ".join(f"{s(i, j)} AS s{i}{j}" for i in range(4, 8) for j in range(i, 8))
    inv0 = {"44": "s55/d0", "55": "s44/d0", "45": "(-s45/d0)"}
    # w = S_k0 S_00^-1 S_0k, a symmetric 2 x 2 matrix
    def w(a: int, c: int) -> str:
        return f"(s4{a}*({inv0['44']}*s4{c} + {inv0['45']}*s5{c}) + s5{a}*({inv0['45']}*s4{c} + {inv0['55']}*s5{c}))"

    return f"""+v AS (SELECT entity, period, quantity - 25 AS a, discount*100 - 5 AS b FROM flag_m WHERE quantity IS NOT NULL AND discount IS NOT NULL),
      l AS (SELECT *, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db, lag(a, 1) OVER w - lag(a, 2) OVER w AS da1, lag(b, 1) OVER w - lag(b, 2) OVER w AS db1,
                   lag(a, 2) OVER w AS a2, lag(b, 2) OVER w AS b2 FROM v WINDOW w AS (PARTITION BY entity ORDER BY period)),
      {st.moments_cte('mom', '(SELECT * FROM l WHERE a2 IS NOT NULL)', ['entity'], ['1.0', 'da1', 'db1', 'da', 'db', 'a2', 'b2'])},
      {st.solve_ctes('mom', ['entity'], {'z': ([1, 2, 3], [4, 5, 6, 7])})},
      c AS (SELECT entity, n, {cells} FROM sol), d AS (SELECT *, s44*s55 - s45*s45 AS d0, s66*s77 - s67*s67 AS dk FROM c),
      e AS (SELECT entity, n, dk, s66, s77, s67, {w(6, 6)} AS w66, {w(6, 7)} AS w67, {w(7, 7)} AS w77 FROM d),
      f AS (SELECT entity, n, (s77*w66 - 2*s67*w67 + s66*w77)/dk AS tr, (w66*w77 - w67*w67)/dk AS det FROM e),
      g AS (SELECT entity, n, (tr + sqrt(greatest(0, tr*tr - 4*det)))/2 AS l1, (tr - sqrt(greatest(0, tr*tr - 4*det)))/2 AS l2 FROM f)
      SELECT entity, 0 AS rank, {r6('l1')} AS eigenvalue, {r6('-n*(ln(1 - l1) + ln(1 - l2))')} AS trace, 23.52 + 0.0 AS crit1 FROM g
      UNION ALL SELECT entity, 1, {r6('l2')}, {r6('-n*ln(1 - l2)')}, 11.65 FROM g"""


@query("q_johansen_pair", sql(_johansen_sql(), "flag_m", recursive=True))
def johansen_pair(spark, d):
    """Two variables, where the eigenvalues have a closed form."""
    panel = b.flag_m(spark, d).select("entity", "period", "quantity", (F.col("discount") * 100).alias("discount"))
    out = systems.johansen_trace(panel, ["entity"], ["quantity", "discount"], 2)
    return out.select("entity", "rank", rounded(F.col("eigenvalue")).alias("eigenvalue"), rounded(F.col("trace")).alias("trace"), "crit1")


_ORDER_Y = [11, 12, 13]


def _order_sql() -> str:
    """Orders one to three of three variables: residual covariances by elimination, their determinants written out."""
    models = {str(p): (list(range(1, 2 + 3 * p)), _ORDER_Y) for p in (1, 2, 3)}

    def s(x: list[int], i: int, j: int) -> str:
        terms = " - ".join(f"{st.beta(r, len(x), i)}*m[{c}][{_ORDER_Y[j]}]" for r, c in enumerate(x, 1))
        return f"(m[{_ORDER_Y[i]}][{_ORDER_Y[j]}] - {terms})/n"

    def cell(i: int, j: int) -> str:
        return f"CASE model {' '.join(f'WHEN {name!r} THEN {s(x, i, j)}' for name, (x, _) in models.items())} END AS s{i}{j}"

    lags = ", ".join(f"lag({v}, {p}) OVER w AS {v}{p}" for p in (1, 2, 3) for v in "abc")
    columns = [f"{v}{p}" for p in (1, 2, 3) for v in "abc"] + list("abc")
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""+v AS (SELECT entity, period, quantity - 25 AS a, discount*100 - 5 AS b, tax*100 - 4 AS c FROM flag_m),
      l AS (SELECT *, {lags} FROM v WINDOW w AS (PARTITION BY entity ORDER BY period)),
      {st.moments_cte('mom', f'(SELECT * FROM l WHERE {complete})', ['entity'], ['1.0', *columns])},
      {st.solve_ctes('mom', ['entity'], models)},
      c AS (SELECT entity, CAST(model AS INTEGER) AS p, n, {', '.join(cell(i, j) for i in range(3) for j in range(i, 3))} FROM sol),
      d AS (SELECT entity, p, n, ln(s00*(s11*s22 - s12*s12) - s01*(s01*s22 - s12*s02) + s02*(s01*s12 - s11*s02)) AS ld FROM c)
      SELECT entity, p, {r6('ld + 18*p/n')} AS aic, {r6('ld + 18*ln(ln(n))*p/n')} AS hq, {r6('ld + 9*ln(n)*p/n')} AS sc,
             {r6('pow((n + 3*p + 1)/(n - 3*p - 1), 3)*exp(ld)')} AS fpe, arg_min(p, ld + 9*ln(n)*p/n) OVER (PARTITION BY entity) AS best_sc
      FROM d WHERE n > 3*p + 1"""


@query("q_var_order_three", sql(_order_sql(), "flag_m", recursive=True))
def var_order_three(spark, d):
    """Three variables and orders, where the determinants have a closed form."""
    levels = [F.col("quantity"), F.col("discount") * 100, F.col("tax") * 100]
    panel = b.flag_m(spark, d).select("entity", "period", *[c.alias(n) for c, n in zip(levels, "abc")])
    out = systems.var_order(panel, ["entity"], ["a", "b", "c"], 3)
    return out.select("entity", "p", *[rounded(F.col(c)).alias(c) for c in ("aic", "hq", "sc", "fpe")], "best_sc")


@query("q_var_order")
def var_order(spark, d):
    return systems.var_order(b.flag_features(spark, d), ["entity"], NK, 10)


@query("q_johansen")
def johansen(spark, d):
    return systems.johansen_trace(b.flag_m(spark, d), ["entity"], LEVELS, 2)


@query("q_arma_backtest")
def arma_backtest(spark, d):
    return arma.arma_backtest(b.growth_q(spark, d), ["entity"], "y", (2, 1), "ARIMA", CUT, b.quarters(spark, d)[1])


@query(
    "q_arma_ar_one",
    sql(
        """SELECT entity, model_id, forecast_period, round(sign(mean)*ln(1 + abs(mean)), 4) + 0.0 AS mean_log, round(sign(upper)*ln(1 + abs(upper)), 4) + 0.0 AS upper_log FROM records
           WHERE model_id LIKE 'ARIMA%' AND mean IS NOT NULL""",
        "records",
    ),
)
def arma_ar_one(spark, d):
    """Without a moving average the conditional sum of squares is least squares.

    Shown on a signed log scale, since unstable fits of short series can be of any size.
    """

    def log(c):
        return rounded(F.signum(c) * F.log1p(F.abs(F.col(c))), 4).alias(f"{c}_log")

    out = arma.arma_backtest(b.growth_q(spark, d), ["entity"], "y", (1, 0), "ARIMA", CUT, b.quarters(spark, d)[1]).filter("mean IS NOT NULL")
    return out.select("entity", "model_id", "forecast_period", log("mean"), log("upper"))


@query("q_arma_order")
def arma_order(spark, d):
    return arma.arma_orders(b.flag_features(spark, d), ["entity"], "y", 10, 10)


def _dim(spark, d):
    """Entries of a vector: one number, the same for all."""
    return b.vectors(spark, d).agg(F.max(F.size("v"))).first()[0] or 1


def _gram(spark, d):
    return factors.gram(b.vectors(spark, d), "v", _dim(spark, d))


@query(
    "q_corr_matrix",
    f"""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
        SELECT CAST(l.i AS INTEGER) AS a, CAST(r.i AS INTEGER) AS b, count(*) AS n, {r6('corr(l.v, r.v)')} AS r FROM x l JOIN x r USING (vec_id) WHERE l.i <= r.i GROUP BY 1, 2""",
)
def corr_matrix(spark, d):
    out = factors.correlation_rows(_gram(spark, d), _dim(spark, d))
    return out.select("a", "b", "n", rounded(F.col("r")).alias("r"))


@query(
    "q_corr_pvalues",
    f"""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
          c AS (SELECT CAST(l.i AS INTEGER) AS a, CAST(r.i AS INTEGER) AS b, count(*) AS n, corr(l.v, r.v) AS r FROM x l JOIN x r USING (vec_id) WHERE l.i < r.i GROUP BY 1, 2),
          t AS (SELECT *, r*sqrt((n - 2)/(1 - r*r)) AS t FROM c)
        SELECT a, b, {r6('t')} AS t, {r6('2*(' + st.t_tail('abs(t)', '(n - 2)') + ')')} AS p_value FROM t""",
)
def corr_pvalues(spark, d):
    """P-values from the data, pairs of different columns only."""
    out = factors.correlation_rows(_gram(spark, d), _dim(spark, d)).filter("a < b")
    return out.select("a", "b", rounded(F.col("t")).alias("t"), rounded(F.col("p_value")).alias("p_value"))


@query(
    "q_pca_identity",
    f"""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
        SELECT vec_id, CAST(i AS INTEGER) AS feature, {r6('(v - avg(v) OVER p)/stddev_samp(v) OVER p')} AS z FROM x WINDOW p AS (PARTITION BY i)""",
)
def pca_identity(spark, d):
    """Scores on all components times loadings: the standardised data, if the decomposition is right."""
    moments = _gram(spark, d)
    scored = factors.scores(b.vectors(spark, d), "v", moments, _dim(spark, d), _dim(spark, d))
    weights = factors.loading_matrix(moments, _dim(spark, d)).scalar()
    rows = scored.withColumn("_w", weights).select("vec_id", F.posexplode(F.transform("_w", lambda w: factors.dot(w, F.col("scores")))).alias("i", "z"))
    return rows.select("vec_id", (F.col("i") + 1).alias("feature"), rounded(F.col("z")).alias("z"))


@query("q_pca")
def pca(spark, d):
    return factors.explained(_gram(spark, d), _dim(spark, d), _dim(spark, d)).drop("k")


@query("q_pca_scores")
def pca_scores(spark, d):
    out = factors.scores(b.vectors(spark, d), "v", _gram(spark, d), _dim(spark, d), 5)
    return out.select("vec_id", *[F.col("scores")[i].alias(f"pc{i + 1}") for i in range(5)])


@query("q_pca_loadings")
def pca_loadings(spark, d):
    """Loadings beside the dictionary group of their feature (25 nations stand for 64 features, cycled)."""
    rows = factors.loading_rows(_gram(spark, d), _dim(spark, d), 5).drop("k")
    named = rows.withColumn("series", F.concat(F.lit("NATION_"), (F.col("feature") % 25).cast("string")))
    return joins.dictionary_join(named, b.info(spark, d), "series", "series")


@query("q_pcr")
def pcr(spark, d):
    """Five-fold principal-component regression of the first component of every vector on the rest."""
    rotated = b.vectors(spark, d).select(
        (F.col("vec_id") % 5).cast("int").alias("fold"), F.concat(F.slice("v", 2, _dim(spark, d) - 1), F.slice("v", 1, 1)).alias("v")
    )
    return factors.pcr_cv(factors.gram(rotated, "v", _dim(spark, d), "fold"), _dim(spark, d), 10)


@query("q_favar_backtest")
def favar_backtest(spark, d):
    panel = b.factor_panel(spark, d)
    full = factors.favar_backtest(panel, ["entity"], "y", b.FACTOR_FEATURES, 1, 3, "FAVAR_FULL", MONTH_CUT, b.ship_months(spark, d)[1])
    return full.unionByName(
        factors.favar_backtest(panel, ["entity"], "y", b.SELECTED_FEATURES, 2, 3, "FAVAR_SW", MONTH_CUT, b.ship_months(spark, d)[1])
    )


@query("q_factor_cv")
def factor_cv(spark, d):
    errors = factors.factor_cv(b.factor_panel(spark, d), ["entity"], "y", b.FACTOR_FEATURES, 8)
    return errors.groupBy("entity", "r").agg(
        F.count("error").alias("folds"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")
    )


@query("q_model_comparison")
def model_comparison(spark, d):
    """All econometric models on one panel, one accuracy table relative to the full FAVAR.

    The panel is staged once: six models read the small table instead of the records behind it.
    """
    panel = stage(b.factor_panel(spark, d), "factor-panel")
    span = (["entity"], "y")
    made = [
        baselines.baseline_records(panel, *span, MONTH_CUT, b.ship_months(spark, d)[1], models=("RW",)),
        arma.arma_backtest(panel, *span, (2, 1), "ARIMA", MONTH_CUT, b.ship_months(spark, d)[1]),
        systems.var_backtest(panel, ["entity"], NK, 2, "VAR_NK", MONTH_CUT, b.ship_months(spark, d)[1]),
        systems.var_backtest(panel, ["entity"], LI, 1, "VAR_LI", MONTH_CUT, b.ship_months(spark, d)[1]),
        factors.favar_backtest(panel, *span, b.FACTOR_FEATURES, 1, 3, "FAVAR_FULL", MONTH_CUT, b.ship_months(spark, d)[1]),
        factors.favar_backtest(panel, *span, b.SELECTED_FEATURES, 2, 3, "FAVAR_SW", MONTH_CUT, b.ship_months(spark, d)[1]),
    ]
    records = stage(bind_rows(*made), "forecast-records", ["model_id"])
    return evaluate.accuracy_table(records, ["entity"], "FAVAR_FULL", literals.model_order(spark))
