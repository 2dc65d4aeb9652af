"""Queries over whole tables against their SQL, and what they must hold."""

import pytest
from test_catalog import FOLDER, pytestmark  # noqa: F401
from test_catalog import test_query_equals_sql as equals_sql

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["token_vault_all", "redact_joined_notes"])
def test_whole_query_equals_sql(spark, name):
    equals_sql(spark, name)


def test_live_and_expired_conversations_together(spark):
    rows = entry.queries()["token_vault_all"](spark, FOLDER).collect()
    assert {r.conv_id % 5 == 0 for r in rows} == {True, False}


def test_joined_notes_are_bounded(spark):
    rows = entry.queries()["redact_joined_notes"](spark, FOLDER).collect()
    assert max(r.restored.count("\n") for r in rows) < 500
