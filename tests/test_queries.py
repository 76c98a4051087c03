"""Every query with SQL gives the rows of its SQL; the others give rows."""

from __future__ import annotations

import pytest
from compare import assert_same, connect

from loomset.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, name):
    assert_same(registry.QUERIES[name](spark, data), connect(data), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
