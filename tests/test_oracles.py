"""Every registered query equals its SQL on the smallest tables."""

import pytest

from docspan.plans.catalog import oracle_sql, queries
from docspan.plans.compare import compare, duck

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir_module):
    return duck(sf_dir_module)


@pytest.fixture(scope="module")
def sf_dir_module():
    return "/root/testdata/sf0.001"


def test_only_the_edit_scripts_lack_sql():
    assert set(QUERIES) - set(SQL) == {"diff_statistics", "diff_edit_lines"}
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_dir_module, name):
    problem, rows, _, _ = compare(spark, sf_dir_module, name, QUERIES[name], SQL.get(name), con)
    assert problem is None, problem


def test_fixture_texts_equal_in_both_engines(spark, con, sf_dir_module):
    from docspan.fixtures import FIXTURES, with_fixtures
    from docspan.plans.compare import rows_of
    from docspan.plans.inputs import fixture

    for name in FIXTURES:
        df = fixture(spark, sf_dir_module, name)
        cur = con.execute(with_fixtures(f"SELECT * FROM {name}"))
        want = rows_of([d[0] for d in cur.description], cur.fetchall())
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want, name
