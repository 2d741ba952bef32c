"""Every core query against its SQL on the smallest tables."""

import pytest

from loomql.plans import core_queries
from tests.compare import connect, rows_of, rows_of_sql

QUERIES, SQL = core_queries.queries(), core_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in SQL:
        assert df.count() > 0, "a query without SQL must at least give rows on these tables"
        return
    assert rows_of(df) == rows_of_sql(connect(sf_dir), SQL[name])


def test_entry(spark, sf_dir):
    assert core_queries.entry(spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name, table", [("math_functions", "lineitem"), ("copy_round_trip", "orders")])
def test_whole_table(spark, sf_dir, name, table):
    (rows,) = connect(sf_dir).execute(f"SELECT count(*) FROM {table}").fetchone()
    assert QUERIES[name](spark, sf_dir).count() == rows


def test_whole_multisets(spark, sf_dir):
    """What both sides share and what only the first has make up the first side."""
    rows = [sum(r.n for r in QUERIES[name](spark, sf_dir).collect()) for name in ("intersect_all", "except_all")]
    (first,) = connect(sf_dir).execute("SELECT count(*) FROM lineitem WHERE l_linestatus = 'F'").fetchone()
    assert min(rows) > 0 and sum(rows) == first
