"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = {"ranked_cohorts", "cohort_slices"}


def cell(x):
    return (0, "") if x is None else (1, round(float(x), 6)) if isinstance(x, int | float) else (2, str(x))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(tuple(map(cell, r)) for r in want)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
