"""Registered queries against their SQL on the small data set."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
CHECKED = [
    "text_scan", "detect_all", "overlap_resolution", "redact_documents", "redact_notes", "policy_layers",
    "custom_rules", "redact_conversations", "redact_table_scope", "audit_conversations", "admission",
    "chunk_rehydration", "vault_misses", "streaming_entity_counts", "message_write_back", "chat_round_trip",
    "custom_pattern_classes", "chunk_frames", "vault_rewritten", "redact_null_scopes", "redact_long_texts", "token_vault_expiry", "rate_limit_stream", "admission_null_callers", "term_dictionary_join", "chunk_stream",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_every_query_has_sql():
    assert set(entry.catalog.queries()) == set(entry.oracles.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    done = entry.entry(spark)
    assert done.columns == ["doc_id", "redacted", "n_entities", "blocked", "token_map"] and done.count() > 0


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    want = plain([c[0] for c in cursor.description], cursor.fetchall())
    assert got and got == want
