"""Queries of the operators for training data against SQL on the small tables."""

import pytest

from lorespark.llm import queries, sql
from tests.test_queries import compare, duck, needs_data  # noqa: F401


@needs_data
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.queries()[name], sql.oracle_sql()[name])
