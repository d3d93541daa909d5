"""Scalar expressions: names, text, numbers, bins, bands and labels."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols spelled out in a cleaned name.
SYMBOL_WORDS = {"'": "", '"': "", "%": "_percent_", "#": "_number_"}


def clean_name(name: Column) -> Column:
    """Upper snake case; a digit before the last capital keeps a trailing lower letter attached."""
    out = name
    for symbol, word in SYMBOL_WORDS.items():
        out = F.replace(out, F.lit(symbol), F.lit(word))
    out = F.regexp_replace(out, "([a-z])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    out = F.regexp_replace(out, "[^A-Za-z0-9]+", "_")
    return F.upper(F.regexp_replace(out, "^_+|_+$", ""))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL for a zero or missing denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def safe_log(value: Column) -> Column:
    return F.when(value > 0, F.log(value))


def normal_quantile(level: float) -> float:
    """Two-sided quantile of a band, for example 1.96 for 95."""
    return NormalDist().inv_cdf(0.5 + level / 200.0)


def band(mean: Column, std_error: Column, level: float = 95.0) -> tuple[Column, Column]:
    z = F.lit(normal_quantile(level))
    return mean - z * std_error, mean + z * std_error


def chi2_tail_even(statistic: Column, df: int) -> Column:
    """Upper chi-square tail for an even number of degrees of freedom (closed form)."""
    if df % 2:
        raise ValueError("closed form needs even df; use tails.chi2_sf")
    half = statistic / 2.0
    term: Column = F.lit(1.0)
    total: Column = F.lit(1.0)
    for i in range(1, df // 2):
        term = term * half / float(i)
        total = total + term
    return F.exp(-half) * total


def stars(p_value: Column) -> Column:
    """Significance marks with strict bounds."""
    return (
        F.when(p_value.isNull(), F.lit(None).cast("string"))
        .when(p_value < 0.01, F.lit("***"))
        .when(p_value < 0.05, F.lit("**"))
        .when(p_value < 0.1, F.lit("*"))
        .otherwise(F.lit(""))
    )


def critical_bucket(statistic: Column, one: Column, five: Column, ten: Column, lower_tail: bool) -> Column:
    """Bucket against three critical values; equality on any bound falls through to ``>0.1``."""
    sign = 1.0 if lower_tail else -1.0
    s, a, b, c = (sign * x for x in (statistic, one, five, ten))
    return (
        F.when(statistic.isNull(), F.lit(None).cast("string"))
        .when((s < c) & (s > b), F.lit("<0.1"))
        .when((s < b) & (s > a), F.lit("<0.05"))
        .when(s < a, F.lit("<0.01"))
        .otherwise(F.lit(">0.1"))
    )


def cut(value: Column, breaks: list[float], right: bool = True) -> Column:
    """Zero-based bin number; ``(a,b]`` by default, ``[a,b)`` otherwise, NULL outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(breaks) - 1)):
        low, high = F.lit(float(breaks[i])), F.lit(float(breaks[i + 1]))
        inside = ((value > low) & (value <= high)) if right else ((value >= low) & (value < high))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def cut_label(value: Column, breaks: list[float], right: bool = True) -> Column:
    """Text of the interval a value falls into."""

    def show(x: float) -> str:
        return "-Inf" if x == float("-inf") else "Inf" if x == float("inf") else f"{x:g}"

    opener, closer = ("(", "]") if right else ("[", ")")
    number = cut(value, breaks, right)
    out = F.lit(None).cast("string")
    for i in range(len(breaks) - 1):
        out = F.when(number == i, F.lit(f"{opener}{show(breaks[i])},{show(breaks[i + 1])}{closer}")).otherwise(out)
    return out


def percent_text(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("bigint").cast("string"), F.lit("%"))
