"""Integer period arithmetic for quarters, months, days and hours.

A quarter is ``year * 4 + quarter - 1`` and a month ``year * 12 + month - 1``: sortable,
subtractable, and free of any session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_index(date: Column) -> Column:
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("int")


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def day_index(stamp: Column, origin: str) -> Column:
    return F.datediff(F.to_date(stamp), F.to_date(F.lit(origin))).cast("int")


def hour_index(stamp: Column, origin: str) -> Column:
    return (day_index(stamp, origin) * 24 + F.hour(stamp)).cast("int")


def quarter(text: str) -> int:
    """Driver-side twin of :func:`parse_quarter` for literal bounds such as ``1999 Q4``."""
    year, part = text.upper().replace(" ", "").split("Q")
    return int(year) * 4 + int(part) - 1


def parse_quarter(text: Column) -> Column:
    """``1999Q4``, ``1999 Q4`` or ``12/1/1999`` to a quarter index, NULL when neither fits."""
    year = F.regexp_extract(text, r"^(\d{4}) ?Q([1-4])$", 1)
    part = F.regexp_extract(text, r"^(\d{4}) ?Q([1-4])$", 2)
    by_name = year.try_cast("int") * 4 + part.try_cast("int") - 1
    return F.coalesce(by_name, quarter_index(F.try_to_date(text, "M/d/yyyy"))).cast("int")


def year_of(period: Column) -> Column:
    return F.floor(period / 4).cast("int")


def quarter_of(period: Column) -> Column:
    return (F.pmod(period, F.lit(4)) + 1).cast("int")


def format_quarter(period: Column, gap: str = " ") -> Column:
    return F.concat(year_of(period).cast("string"), F.lit(gap + "Q"), quarter_of(period).cast("string"))


def quarter_start(period: Column) -> Column:
    return F.make_date(year_of(period), (quarter_of(period) - 1) * 3 + 1, F.lit(1))


def month_start(period: Column) -> Column:
    return F.make_date(F.floor(period / 12).cast("int"), (F.pmod(period, F.lit(12)) + 1).cast("int"), F.lit(1))


def quarter_bounds(first: int | None, last: int | None) -> tuple[str | None, str | None]:
    """Literal dates ``[from, to)`` of a quarter range, for filters a Parquet scan can use."""

    def day(p: int) -> str:
        return f"{p // 4:04d}-{p % 4 * 3 + 1:02d}-01"

    return (None if first is None else day(first)), (None if last is None else day(last + 1))
