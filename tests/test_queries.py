from __future__ import annotations

import pytest

from quillstream import plans
from tests.compare import both

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    got, wanted = both(spark, sf, QUERIES[name], SQL[name])
    assert got == wanted
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
