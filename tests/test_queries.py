"""Every registered query: the same rows as its SQL, or at least that it runs and has a schema."""

import pytest

import __spark_entry__ as entry

from support import SF, duck, rows, same_types

# the queries of the llm subpackage are tested beside it
QUERIES, SQL = ({n: q for n, q in d.items() if entry.llm_queries is None or n not in entry.llm_queries.QUERIES} for d in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query_matches_sql(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.execute(SQL[name]).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    same_types(con, df, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
