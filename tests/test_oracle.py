"""Every catalog query against its SQL on the smallest tables."""

import pytest

from lemmaforge.plans import catalog
from tests.oracle import by_spark, by_sql

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_names_match():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = by_spark(QUERIES[name](spark, sf))
    if name in SQL:
        assert got == by_sql(SQL[name], sf)
    else:
        assert got[1]
