"""Every query with SQL gives the same rows as that SQL; every other query gives rows."""

from pathlib import Path

import duckdb
import pytest
from check_oracles import canonical

import __spark_entry__ as entry
from conftest import DATA

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
    assert "q_flagship" in ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert frame.columns
    frame.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
