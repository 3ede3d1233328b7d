"""Every catalog query against its SQL twin in DuckDB on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bitloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(arrow, cols):
    fix = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted(zip(*[[fix(v) for v in arrow[c].to_pylist()] for c in cols]), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = queries()[name](spark, SF).toArrow()
    want = con.sql(oracle_sql()[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert rows(got, cols) == rows(want, cols)


def test_every_query_has_a_twin_or_its_own_test():
    assert set(QUERIES) - set(ORACLES) == {"mlp_flow_scoring"}


def test_entry_holds_the_catalog():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 10
