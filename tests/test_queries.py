"""Every registered query against its SQL twin over the smallest tables."""

import pytest

from barloom.plans import queries as q

SQL = q.oracle_sql()


def test_every_query_has_a_twin():
    assert set(SQL) == set(q.queries())


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(name, spark, sf_dir, same):
    same(q.queries()[name](spark, sf_dir), SQL[name])
