import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import periods, scalars, tails
from seriesloom.sources import literals


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("UMCSENTx", "UMCSEN_TX"), ("TLBSNNCBBDIx", "TLBSNNCBBD_IX"), ("NWPIx", "NWP_IX"), ("GS1TB3Mx", "GS1TB3MX"),
        ("CPF3MTB3Mx", "CPF3MTB3MX"), ("S&P 500", "S_P_500"), ("  odd--name ", "ODD_NAME"), ("share%", "SHARE_PERCENT"),
    ],
)
def test_clean_name(spark, raw, cleaned):
    assert one(spark, raw, "string", scalars.clean_name) == cleaned


@pytest.mark.parametrize("text, period", [("1999Q4", 7999), ("1999 Q4", 7999), ("12/1/1999", 7999), ("1999Q5", None), ("x", None)])
def test_parse_quarter(spark, text, period):
    assert one(spark, text, "string", periods.parse_quarter) == period


def test_period_text_round_trip(spark):
    for p in (7980, 7999, 8003):
        text = one(spark, p, "int", periods.format_quarter)
        assert periods.quarter(text) == p
        assert one(spark, text, "string", periods.parse_quarter) == p


def test_cut_edges(spark):
    right = lambda v: one(spark, v, "double", lambda c: scalars.cut_label(c, [1, 2, 3]))
    left = lambda v: one(spark, v, "double", lambda c: scalars.cut_label(c, [1, 2, 3], right=False))
    assert [right(v) for v in (1.0, 2.0, 3.0, 3.1)] == [None, "(1,2]", "(2,3]", None]
    assert [left(v) for v in (1.0, 2.0, 3.0)] == ["[1,2)", "[2,3)", None]


def test_bucket_equality_falls_through(spark):
    lits = [F.lit(-2.6), F.lit(-1.95), F.lit(-1.6)]
    get = lambda v: one(spark, v, "double", lambda c: scalars.critical_bucket(c, *lits, lower_tail=True))
    assert [get(v) for v in (-1.5, -1.6, -1.7, -1.95, -2.0, -2.6, -2.7)] == [">0.1", ">0.1", "<0.1", ">0.1", "<0.05", ">0.1", "<0.01"]


def test_guards(spark):
    assert one(spark, 0.0, "double", lambda c: scalars.ratio(F.lit(1.0), c)) is None
    assert one(spark, -1.0, "double", scalars.safe_log) is None
    assert math.copysign(1, one(spark, -1e-9, "double", scalars.rounded)) == 1


def test_tails_against_known_values():
    assert tails.normal_tail(np.array([1.959963984540054]))[0] == pytest.approx(0.025, abs=1e-12)
    assert tails.t_tail(np.array([2.015048372669157]), np.array([5.0]))[0] == pytest.approx(0.05, abs=1e-9)
    assert tails.t_tail(np.array([-2.015048372669157]), np.array([5.0]))[0] == pytest.approx(0.95, abs=1e-9)
    assert tails.gamma_tail(np.array([5.0]), np.array([18.307038053275146 / 2]))[0] == pytest.approx(0.05, abs=1e-9)
    assert tails.gamma_tail(np.array([0.5]), np.array([3.841458820694124 / 2]))[0] == pytest.approx(0.05, abs=1e-9)
    assert tails.f_tail(np.array([3.325834529923155]), np.array([5.0]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-7)
    for df in (1.0, 2.0, 7.0, 60.0, 400.0):
        t = np.array([0.3, 1.1, 2.7])
        assert np.allclose(2 * tails.t_tail(t, df), tails.f_tail(t * t, 1.0, df), atol=1e-12)
        assert np.allclose(tails.f_tail(t, 2.0, df), (1 + 2 * t / df) ** (-df / 2), atol=1e-12)


def test_calendar_literals(spark):
    rows = literals.vintages(spark).orderBy("vintage_period").collect()
    assert len(rows) == 46 and rows[0]["value"] == 0.149 and rows[-1]["value"] == -0.575
    assert rows[-1]["vintage_period"] == periods.quarter("2019 Q3")
    assert literals.recessions(spark).count() == 11
    assert literals.code_overrides(spark).count() == 14
