"""Every registered llm query: the same rows as its SQL, or at least that it runs and has a schema."""

import pytest

from dealweave.llm.queries import ORACLE_SQL, QUERIES
from support import SF, duck, same_types
from support import rows as plain_rows


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_query_matches_sql(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name]).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain_rows(got) == plain_rows(want)
    same_types(con, df, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_pairs_links_and_classes_agree(spark):
    pairs, classes = QUERIES["p9_found"](spark, SF).collect(), QUERIES["p9_classes"](spark, SF).collect()
    assert sum(r.n_links for r in classes) == 2 * len(pairs)
    pairs, rows = QUERIES["p4_found"](spark, SF).collect(), QUERIES["p4_entities"](spark, SF).collect()
    assert sum(r.n_links for r in rows) == 2 * len(pairs) > 0
