"""Literal lookup tables. Values are fixed facts or study settings; order is natural."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.periods import quarter

# Rows up to which a literal table may carry a broadcast hint.
BROADCAST_ROWS = 10_000

# First and last quarter of each recession.
RECESSIONS = [
    ("1948 Q4", "1949 Q3"),
    ("1953 Q3", "1954 Q2"),
    ("1957 Q3", "1958 Q1"),
    ("1960 Q2", "1961 Q1"),
    ("1970 Q1", "1970 Q4"),
    ("1974 Q1", "1975 Q1"),
    ("1980 Q1", "1980 Q2"),
    ("1981 Q3", "1982 Q4"),
    ("1990 Q3", "1991 Q1"),
    ("2001 Q2", "2001 Q4"),
    ("2008 Q1", "2009 Q2"),
]

# Growth of one quarter as published in each quarter from 2008 Q2 on.
VINTAGE_VALUES = [
    0.149, 0.218, 0.218, 0.218, 0.218, -0.181, -0.181, -0.181, -0.181, -0.182, -0.182, -0.182,
    -0.182, -0.444, -0.444, -0.444, -0.444, -0.444, -0.444, -0.444, -0.444, -0.672, -0.672, -0.672,
    -0.672, -0.682, -0.682, -0.682, -0.682, -0.682, -0.682, -0.682, -0.682, -0.682, -0.682, -0.682,
    -0.682, -0.682, -0.682, -0.682, -0.682, -0.575, -0.575, -0.575, -0.575, -0.575,
]
FIRST_VINTAGE = "2008 Q2"

# Transformation codes that replace the published ones.
CODE_OVERRIDES = {
    "TLBSNNCBBD_IX": 2,
    "TLBSNNBBD_IX": 2,
    "CUMFNS": 2,
    "AWHMAN": 2,
    "BAA10YM": 5,
    "GS10TB3MX": 2,
    "GS1TB3MX": 2,
    "UMCSEN_TX": 5,
    "COMPAPFF": 2,
    "TB3SMFFM": 2,
    "A014RE1Q156NBEA": 2,
    "CPF3MTB3MX": 2,
    "AAAFFM": 2,
    "NWP_IX": 5,
}

# Displayed model names, in display order.
MODEL_LABELS = [
    ("RW", "RW"),
    ("ARIMA", "ARIMA"),
    ("VAR_LI", "LI VAR"),
    ("VAR_NK", "NK VAR"),
    ("FAVAR_FULL", "Full FAVAR"),
    ("FAVAR_SW", "S&W FAVAR"),
    ("RF", "RF"),
    ("GB", "GB"),
    ("SVR", "SVR"),
]

# Models compared in each information set (lags only, leading indicators, everything).
INFORMATION_SETS = {
    1: ["RW", "ARIMA", "RF", "GB", "SVR"],
    2: ["RW", "ARIMA", "VAR_LI", "VAR_NK", "RF", "GB", "SVR"],
    3: ["RW", "ARIMA", "VAR_LI", "VAR_NK", "FAVAR_FULL", "FAVAR_SW", "RF", "GB", "SVR"],
}
LEARNERS = ("RF", "GB", "SVR")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver, hinted for broadcast only while its known size allows it."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def regime_rows() -> list[tuple[int, int, int]]:
    return [(i + 1, quarter(a), quarter(b)) for i, (a, b) in enumerate(RECESSIONS)]


def recessions(spark: SparkSession) -> DataFrame:
    return literal_table(spark, regime_rows(), "regime_id int, start int, end int")


def vintages(spark: SparkSession, ref_period: str = "2008 Q1") -> DataFrame:
    first, ref = quarter(FIRST_VINTAGE), quarter(ref_period)
    rows = [(ref, first + i, v) for i, v in enumerate(VINTAGE_VALUES)]
    return literal_table(spark, rows, "ref_period int, vintage_period int, value double")


def code_overrides(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(CODE_OVERRIDES.items()), "series string, code int")


def model_order(spark: SparkSession) -> DataFrame:
    rows = [(m, i + 1, label) for i, (m, label) in enumerate(MODEL_LABELS)]
    return literal_table(spark, rows, "model_id string, pos int, label string")


def model_set_rows() -> list[tuple[int, str, str]]:
    """(information set, horizon, model id); learners carry the set, econometric models do not."""
    rows = []
    for number, models in INFORMATION_SETS.items():
        for horizon in ("Q", "Y"):
            for m in models:
                rows.append((number, horizon, f"{m}_{horizon}_I{number}" if m in LEARNERS else f"{m}_{horizon}"))
    return rows


def model_sets(spark: SparkSession) -> DataFrame:
    return literal_table(spark, model_set_rows(), "info_set int, horizon string, model_id string")
