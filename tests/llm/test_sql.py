"""Corpus queries against their SQL on another engine."""

import pytest

from hornspark.llm.registry import QUERIES, SQL

from ..oracle import DATA, same_rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same_rows(spark, QUERIES[name], SQL[name])
