"""Every core query against its SQL on the smallest tables; those without SQL run and have rows."""

import os

import pytest

from inkwell.plans import compaction, matched, ranking, raster, records, relational, reports, scalars, state, stores, trends

from .oracle import SF, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES = {n: (f, m.ORACLE.get(n)) for m in (compaction, scalars, relational, ranking, matched, records, reports, state, stores, trends, raster) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    query, sql = QUERIES[name]
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        same(spark, con, query, sql)


def test_registry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
