"""Every query against its SQL over the whole small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from onsetlens.plans.catalog import QUERIES as CORE

QUERIES, SQL = entry.queries(), entry.oracle_sql()
FITS = {"fit_parameters", "fit_panels"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame):
    names = sorted(frame.columns)

    def plain(value):
        return None if value is None or value != value else value

    rows = [tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False, name=None)]
    return names, sorted(rows, key=lambda row: [(v is None, v if v is not None else 0) for v in row])


def test_every_query_but_the_fits_has_sql():
    assert set(CORE) - set(SQL) == FITS


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, small, name):
    found, wanted = rows_of(QUERIES[name](spark, small).toPandas()), rows_of(duck.execute(SQL[name]).df())
    assert found[0] == wanted[0] and len(found[1]) == len(wanted[1]) > 0
    assert found[1] == wanted[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 17 * 51


def test_broadcasts_are_bounded(spark, small):
    """No table of persons or tests is broadcast by a hint of ours."""
    for name in ("infection_bounds", "assign_cohorts", "cohort_counts", "empirical_curve"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().logical().toString()
        assert "strategy=broadcast" not in plan, name
