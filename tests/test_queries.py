import os

import oracle
import pytest

from squigspark import kernel_queries, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="the tables are not here")
QUERIES, ORACLE = queries.QUERIES | kernel_queries.QUERIES, queries.ORACLE | kernel_queries.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    oracle.same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, oracle.FOLDER).count() > 0
