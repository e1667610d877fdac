"""The operators that SQL can express against their SQL, on whole tables."""

import pytest

from graphloom.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import connect, differences

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(DATA), ORACLE_SQL[name]) == ""
