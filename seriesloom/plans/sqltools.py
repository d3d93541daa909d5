"""Least squares in plain SQL, so that regression queries can be checked against DuckDB."""

from __future__ import annotations


def moments_cte(name: str, source: str, keys: list[str], z: list[str]) -> str:
    """Count and full cross-product matrix (list of lists) of the expressions ``z`` per key."""
    rows = ", ".join("[" + ", ".join(f"sum(CAST({a} AS DOUBLE)*({b}))" for b in z) + "]" for a in z)
    by = ", ".join(keys)
    return f"{name} AS (SELECT {by}, CAST(count(*) AS DOUBLE) AS n, [{rows}] AS m FROM {source} GROUP BY {by})"


def solve_ctes(source: str, keys: list[str], models: dict[str, tuple[list[int], list[int]]], tag: str = "") -> str:
    """Gauss-Jordan elimination of every model's normal equations.

    A model is (regressor columns, target columns), one-based in ``m``. The result ``sol`` has the
    reduced matrix ``a``: targets' coefficients follow the unit block, then comes the inverse.
    """
    by = ", ".join(keys)
    parts = []
    for model, (x, y) in models.items():
        lines = []
        for r, i in enumerate(x):
            unit = ["1.0" if c == r else "0.0" for c in range(len(x))]
            lines.append("[" + ", ".join([f"m[{i}][{j}]" for j in [*x, *y]] + unit) + "]")
        parts.append(f"SELECT {by}, n, m, '{model}' AS model, [{', '.join(lines)}] AS a FROM {source}")
    return f"""sys{tag} AS ({' UNION ALL '.join(parts)}),
      gj{tag} AS (SELECT *, CAST(1 AS BIGINT) AS k FROM sys{tag}
        UNION ALL SELECT {by}, n, m, model, list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a[1]) + 1),
          lambda j: CASE WHEN i = k THEN a[k][j]/a[k][k] ELSE a[i][j] - a[i][k]*a[k][j]/a[k][k] END)), k + 1
        FROM gj{tag} WHERE k <= len(a)),
      sol{tag} AS (SELECT * FROM gj{tag} WHERE k = len(a) + 1)"""


def beta(r: int, size: int, target: int = 0) -> str:
    """Coefficient of the r-th regressor (one-based) for a target (zero-based)."""
    return f"a[{r}][{size + 1 + target}]"


def inverse(r: int, size: int, targets: int = 1) -> str:
    return f"a[{r}][{size + targets + r}]"


def rss(x: list[int], y: int, target: int = 0) -> str:
    terms = " - ".join(f"{beta(r, len(x), target)}*m[{i}][{y}]" for r, i in enumerate(x, 1))
    return f"(m[{y}][{y}] - {terms})"


def interpolate(value: str, points: list[float], levels: list[float]) -> str:
    """Piecewise linear with constant ends."""
    arms = [f"WHEN {value} <= {points[0]} THEN {levels[0]}"]
    for a, c, p, q in zip(points, points[1:], levels, levels[1:]):
        arms.append(f"WHEN {value} < {c} THEN {p} + ({value} - ({a}))/({c} - ({a}))*({q} - {p})")
    return f"CASE WHEN {value} IS NULL THEN NULL {' '.join(arms)} ELSE {levels[-1]} END"


def t_tail(t: str, df: str) -> str:
    """Upper tail of the t law for an integer number of degrees of freedom (finite trigonometric sums)."""
    angle = f"atan(abs({t})/sqrt({df}))"
    odd = (
        f"2/pi()*({angle} + CASE WHEN {df} > 1 THEN sin({angle})*list_sum(list_transform(range(0, CAST(({df} - 1)//2 AS BIGINT)), "
        f"lambda k: exp(k*ln(4.0) + 2*lgamma(k + 1.0) - lgamma(2*k + 2.0))*pow(cos({angle}), 2*k + 1))) ELSE 0 END)"
    )
    even = (
        f"sin({angle})*list_sum(list_transform(range(0, CAST({df}//2 AS BIGINT)), "
        f"lambda k: exp(lgamma(2*k + 1.0) - k*ln(4.0) - 2*lgamma(k + 1.0))*pow(cos({angle}), 2*k)))"
    )
    inner = f"CASE WHEN CAST({df} AS BIGINT) % 2 = 1 THEN {odd} ELSE {even} END"
    return f"CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL ELSE 0.5 - sign({t})*0.5*({inner}) END"
