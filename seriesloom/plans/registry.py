"""Query registry and the shared SQL of the test panels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.sources import literals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# End of training (1999 Q4). Where calendars begin and end is read from the data.
CUT = 7999
EPOCH = "2024-01-01"

_regimes = ", ".join(str(r) for r in literals.regime_rows())


def _span(period: str, source: str) -> str:
    return f"SELECT min({period}) AS a, max({period}) AS z FROM {source}"


def _calendar(span: str) -> str:
    return f"(SELECT unnest(range(a, z + 1)) AS p FROM {span})"


LAST_QUARTER, LAST_SHIPPED = "(SELECT z FROM quarters)", "(SELECT z FROM ship_months)"

CTES: dict[str, str] = {
    "quarters": _span("CAST(year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS INTEGER)", "orders"),
    "order_months": _span("CAST(year(o_orderdate)*12 + month(o_orderdate) - 1 AS INTEGER)", "orders"),
    "ship_months": _span("CAST(year(l_shipdate)*12 + month(l_shipdate) - 1 AS INTEGER)", "lineitem"),
    "hours": _span("period", "event_raw"),
    "regimes": f"SELECT * FROM (VALUES {_regimes}) t(regime_id, s, e)",
    "nation_raw": """
        SELECT n_name AS entity, CAST(year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS INTEGER) AS period,
               sum(o_totalprice) AS value, count(*) AS n_orders
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2""",
    "nation_q": f"""
        SELECT k.entity, CAST(p AS INTEGER) AS period, value, n_orders
        FROM (SELECT DISTINCT entity FROM nation_raw) k CROSS JOIN {_calendar("quarters")} t
             LEFT JOIN nation_raw r ON r.entity = k.entity AND r.period = p""",
    "growth_q": """
        SELECT entity, period, value, 100.0*(value/nullif(lag(value) OVER w, 0) - 1.0) AS y
        FROM nation_q WINDOW w AS (PARTITION BY entity ORDER BY period)""",
    "codes": "SELECT n_name AS series, CAST(n_nationkey % 7 + 1 AS INTEGER) AS code FROM nation",
    "info": """
        SELECT n_name AS series, r_name AS grp, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS factors
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "priority_raw": """
        SELECT o_orderpriority AS entity, CAST(year(o_orderdate)*12 + month(o_orderdate) - 1 AS INTEGER) AS period,
               sum(o_totalprice) AS value
        FROM orders GROUP BY 1, 2""",
    "priority_m": f"""
        SELECT k.entity, CAST(p AS INTEGER) AS period, value
        FROM (SELECT DISTINCT entity FROM priority_raw) k CROSS JOIN {_calendar("order_months")} t
             LEFT JOIN priority_raw r ON r.entity = k.entity AND r.period = p""",
    "flag_raw": """
        SELECT l_returnflag AS entity, CAST(year(l_shipdate)*12 + month(l_shipdate) - 1 AS INTEGER) AS period,
               sum(l_extendedprice*(1 - l_discount)) AS revenue, avg(l_quantity) AS quantity,
               avg(l_discount) AS discount, avg(l_tax) AS tax, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
    "flag_m": f"""
        SELECT k.entity, CAST(p AS INTEGER) AS period, revenue, quantity, discount, tax, n
        FROM (SELECT DISTINCT entity FROM flag_raw) k CROSS JOIN {_calendar("ship_months")} t
             LEFT JOIN flag_raw r ON r.entity = k.entity AND r.period = p""",
    "event_raw": f"""
        SELECT event_type AS entity,
               CAST(date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE))*24 + hour(ts) AS INTEGER) AS period,
               count(*) AS n, avg(value) AS avg_value
        FROM events GROUP BY 1, 2""",
    "event_h": f"""
        SELECT k.entity, CAST(p AS INTEGER) AS period, CAST(coalesce(n, 0) AS DOUBLE) AS x
        FROM (SELECT DISTINCT entity FROM event_raw) k CROSS JOIN {_calendar("hours")} t
             LEFT JOIN event_raw r ON r.entity = k.entity AND r.period = p""",
    "event_d": f"""
        SELECT event_type AS entity, CAST(date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE)) AS INTEGER) AS period,
               avg(value) AS x
        FROM events GROUP BY 1, 2""",
    "base": """
        SELECT entity, period AS o, y, avg((y - yl)*(y - yl)) OVER e AS step2, avg(y) OVER e AS mu, stddev_pop(y) OVER e AS sd,
               CASE WHEN regr_count(y, yl) OVER e >= 3 THEN regr_slope(y, yl) OVER e END AS b,
               CASE WHEN regr_count(y, yl) OVER e >= 3 THEN regr_intercept(y, yl) OVER e END AS c,
               CASE WHEN regr_count(y, yl) OVER e >= 3 THEN greatest(0.0, (regr_syy(y, yl) OVER e)*(1.0 - regr_r2(y, yl) OVER e)/(regr_count(y, yl) OVER e)) END AS v,
               lead(y, 1) OVER w AS t1, lead(y, 4) OVER w AS t4
        FROM (SELECT entity, period, y, lag(y) OVER (PARTITION BY entity ORDER BY period) AS yl FROM growth_q)
        WINDOW w AS (PARTITION BY entity ORDER BY period), e AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING)""",
    "records": f"""
        SELECT entity, model_id, horizon, o AS training_end, h AS periods_ahead, CAST(o + h AS INTEGER) AS forecast_period, t AS true_value,
               m AS mean, m - 1.959963984540054*se AS lower, m + 1.959963984540054*se AS upper, t - m AS error,
               'iterated' AS strategy, '95%' AS band_kind
        FROM (
          SELECT entity, o, 'RW_Q' AS model_id, 'Q' AS horizon, 1 AS h, t1 AS t, y AS m, sqrt(step2) AS se FROM base
          UNION ALL SELECT entity, o, 'RW_Y', 'Y', 4, t4, y, sqrt(step2*4) FROM base
          UNION ALL SELECT entity, o, 'MEAN_Q', 'Q', 1, t1, mu, sd FROM base
          UNION ALL SELECT entity, o, 'MEAN_Y', 'Y', 4, t4, mu, sd FROM base
          UNION ALL SELECT entity, o, 'ARIMA_Q', 'Q', 1, t1, c + b*y, sqrt(v) FROM base
          UNION ALL SELECT entity, o, 'ARIMA_Y', 'Y', 4, t4, c*(1 + b + b*b + b*b*b) + b*b*b*b*y, sqrt(v*(1 + pow(b,2) + pow(b,4) + pow(b,6))) FROM base)
        WHERE o + h BETWEEN {CUT + 1} AND {LAST_QUARTER}""",
    "rel": """
        SELECT *, error/nullif(max(CASE WHEN model_id = 'RW_' || horizon THEN error END) OVER (PARTITION BY entity, horizon, forecast_period), 0) AS rel_error
        FROM records""",
    "trials": """
        SELECT l_returnflag AS learner, l_orderkey*8 + l_linenumber AS trial_id, l_quantity AS trees, l_discount AS rate,
               l_tax AS cost, l_extendedprice/1000.0 AS rmse
        FROM lineitem""",
}
_USES = {
    "nation_q": ["quarters", "nation_raw"],
    "growth_q": ["quarters", "nation_raw", "nation_q"],
    "priority_m": ["order_months", "priority_raw"],
    "flag_m": ["ship_months", "flag_raw"],
    "event_h": ["event_raw", "hours"],
    "base": ["quarters", "nation_raw", "nation_q", "growth_q"],
    "records": ["quarters", "nation_raw", "nation_q", "growth_q", "base"],
    "rel": ["quarters", "nation_raw", "nation_q", "growth_q", "base", "records"],
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """Prefix a statement with the panel definitions it uses."""
    order: list[str] = []
    for n in names:
        for need in [*_USES.get(n, []), n]:
            if need not in order:
                order.append(need)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    if not head:
        return body
    joiner = ",\n" if body.lstrip().startswith("+") else "\n"
    body = body.lstrip().removeprefix("+")
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{joiner}{body}"


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0"
