"""The line queries against their SQL."""

import pytest
from test_catalog import pytestmark  # noqa: F401
from test_catalog import test_query_equals_sql as equals_sql


@pytest.mark.parametrize("name", ["op5_line_dedup", "op5_every_line_dedup", "op11_vector_codes", "op13_conversation_repair"])
def test_query_equals_its_sql(spark, name):
    equals_sql(spark, name)
