"""The queries of the problems against their SQL on the smallest tables; those without SQL run and have rows."""

import os

import pytest

from inkwell.llm import queries as Q

from ..oracle import SF, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, con, name):
    if name in Q.ORACLE:
        assert same(spark, con, Q.QUERIES[name], Q.ORACLE[name]) > 0
    else:
        assert Q.QUERIES[name](spark, SF).count() > 0
