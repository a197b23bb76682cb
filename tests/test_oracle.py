"""Every registered query against its DuckDB oracle (sf0.01, as the driver checks)."""

import pytest

import __spark_entry__ as entry
from parkops.plans import catalog
from parkops.plans.verify import duck, rows
from settings import SF_CHECK, SF_SMALL

# the operators on training data have their own tests
QUERIES = {name: fn for name, fn in entry.queries().items() if name in catalog.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    rows_only = set()
    assert set(QUERIES) - set(ORACLES) == rows_only


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "occupancy_rate" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    # sf0.01: several partitions per table, as in the driver's check
    got = QUERIES[name](spark, SF_CHECK).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)


def test_booking_stream_kinds(spark):
    df = QUERIES["stream_booking_expiry"](spark, SF_SMALL)
    kinds = {r["kind"] for r in df.select("kind").distinct().collect()}
    assert {"booked", "expired"} <= kinds <= {"booked", "rejected", "extended", "no_booking", "checked_out", "expired"}
