"""Input tables of the registered queries, and text derived from them.

``documents``, ``pages`` and ``conversations`` hold few kinds of personal data, so two derived tables
add the rest: ``notes`` (one text per customer, all entity types, some overlapping, some invalid) and
``chats`` (the conversations with contact details and orders put in).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.staging import spread
from veilspark.sources.text import read_texts

_DAY = "date_add(DATE'1990-01-01', CAST(k % 9000 AS INT))"
_PERSON = "element_at(array('Alice Chen', 'Bob Lee', 'Carla De Diaz', 'Zoe'), CAST(k % 4 + 1 AS INT))"
_STREET = "element_at(array('Street', 'ave', 'Terrace, Apt 4B', 'Blvd.', 'Hollow'), CAST(k % 5 + 1 AS INT))"

# Each part is a Spark SQL expression over the customer key ``k`` and name ``c_name``.
NOTE_PARTS = (
    "'Account of ' || c_name || ', seen ' || date_format(DAY, 'yyyy-MM-dd') || ' by Dr. ' || PERSON || ' '",
    "date_format(DAY, 'MMMM d, yyyy') || '. Again on ' || date_format(DAY, 'd MMM yyyy') || ' and '",
    "date_format(DAY, 'M/d/yy') || '. Hi, my name is ' || PERSON || ' and I''m here since 1990. ssn '",
    "lpad(CAST(k % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(k % 100 AS STRING), 2, '0') || '-'",
    "lpad(CAST(k % 10000 AS STRING), 4, '0') || ' call (415) 555-' || lpad(CAST(k % 10000 AS STRING), 4, '0')",
    "' or +1 415.555.' || lpad(CAST(k % 977 AS STRING), 4, '0') || ' ' || CAST(k % 900 + 1 AS STRING) || ' Maple '",
    "STREET || ' mail user' || CAST(k % 50 AS STRING) || '@mail' || CAST(k % 7 AS STRING) || '.example.com, '",
    "'user' || CAST(k % 50 AS STRING) || '@mail' || CAST(k % 7 AS STRING) || '.example.com or O.Brien+'",
    "CAST(k AS STRING) || '@example.co.uk. card 4111 1111 1111 ' || lpad(CAST(k % 10000 AS STRING), 4, '0')",
    "' café' || '4111111111111111 and 4111-1111-1111-1111. host ' || CAST(k % 300 AS STRING) || '.10.'",
    "CAST(k % 7 AS STRING) || '.' || CAST(k % 10 AS STRING) || ' addr 2001:0db8:85a3:0000:0000:8a2e:0370:'",
    "lpad(lower(hex(k % 65536)), 4, '0') || ' and fe80::' || lower(hex(k % 4096)) || ' token eyJ' || md5(CAST(k AS STRING))",
    "'.eyJ' || md5(CAST(k + 1 AS STRING)) || '.' || md5(CAST(k + 2 AS STRING)) || ' key sk-' || md5(CAST(k AS STRING))",
    "' AKIA' || upper(substring(md5(CAST(k AS STRING)), 1, 16)) || ' end.'",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_texts(spark, f"{folder}/documents.parquet", "doc_id")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_texts(spark, f"{folder}/pages.parquet", "page_id", text="html")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """``note_id, tenant, text``: one text per customer."""
    parts = " || ".join(NOTE_PARTS).replace("DAY", _DAY).replace("PERSON", _PERSON).replace("STREET", _STREET)
    keyed = spread(table(spark, folder, "customer").selectExpr("c_custkey AS k", "c_name", "c_nationkey"), "k")
    return keyed.select(
        F.col("k").alias("note_id"), F.col("c_nationkey").alias("tenant"), F.expr(parts).alias("text")
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``src, id, text`` over documents, pages and notes."""
    return (
        documents(spark, folder)
        .select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text")
        .unionByName(pages(spark, folder).select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), "text"))
        .unionByName(notes(spark, folder).select(F.lit("notes").alias("src"), F.col("note_id").alias("id"), "text"))
    )


def chats(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, turn, role, text``: conversations with personal data put in."""
    contact = (
        "' write to u' || CAST((conv_id + turn) % 5 AS STRING) || '@example.com, u' || CAST(conv_id % 3 AS STRING) || "
        "'@example.com or call 415-555-' || lpad(CAST(turn % 4 AS STRING), 4, '0')"
    )
    secret = "CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN ' ssn 123-45-6789' ELSE '' END"
    return spread(table(spark, folder, "conversations"), "conv_id", "turn").selectExpr(
        "conv_id", "turn", "role", f"'Hello. ' || text || {contact} || {secret} AS text"
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """``caller, request_id, ts_ms, route, ts``: the events as requests."""
    return table(spark, folder, "events").selectExpr(
        "CAST(user_id AS STRING) AS caller",
        "event_id AS request_id",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms",
        "CASE event_type WHEN 'error' THEN '/health' WHEN 'click' THEN '/v1/redact' "
        "ELSE '/v1/chat/completions' END AS route",
        "CAST(ts AS TIMESTAMP) AS ts",
    )


def reply_text() -> str:
    return (
        "'Dear [NAME_1], ' || text || ' mail [EMAIL_1] or [EMAIL_11] call [PHONE_1][SSN_9] [note 1] ["
        + "A" * 70
        + "] [X'"
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """``stream_id, text``: one model reply with placeholders per conversation turn."""
    return spread(table(spark, folder, "conversations"), "conv_id", "turn").selectExpr(
        "conv_id", "turn", "conv_id || ':' || turn AS stream_id", f"{reply_text()} AS text"
    )


def reply_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The replies without their texts, for what needs only their ids."""
    keys = table(spark, folder, "conversations").select("conv_id", "turn")
    return spread(keys, "conv_id", "turn").selectExpr("conv_id", "turn", "conv_id || ':' || turn AS stream_id")


def reply_maps(replies: DataFrame) -> DataFrame:
    """``stream_id, token_map`` for the replies."""
    return replies.selectExpr(
        "stream_id",
        "map('[NAME_1]', 'Ms. Ada Byron', '[EMAIL_1]', 'u' || conv_id || '@example.com', "
        "'[EMAIL_11]', 'v' || turn || '@example.com', '[PHONE_1]', '415-555-0132') AS token_map",
    )


def reply_lines(replies: DataFrame, width: int = 7) -> DataFrame:
    """The replies as event lines: a role, texts of ``width`` characters with id and model, a finish reason
    for two turns of three, usage, a broken and an empty line, and the end marker."""
    texts = (
        f"transform(sequence(0, CAST((length(text) - 1) DIV {width} AS INT)), i -> concat('data: ', to_json(named_struct("
        f"'id', stream_id, 'model', 'm', 'choices', array(named_struct('index', 0, 'delta', "
        f"named_struct('content', substring(text, i * {width} + 1, {width}))))))))"
    )
    role = (
        "'data: {\"id\":\"' || stream_id || '\",\"model\":\"m\",\"choices\":[{\"index\":0,\"delta\":{\"role\":\"assistant\"},"
        "\"finish_reason\":null}]}'"
    )
    finish = (
        "CASE WHEN turn % 3 = 0 THEN ': no finish' ELSE 'data: {\"id\":\"' || stream_id || "
        "'\",\"choices\":[{\"index\":0,\"delta\":{},\"finish_reason\":\"stop\"}]}' END"
    )
    rest = "'data: {\"choices\":[],\"usage\":{\"total_tokens\":7}}', 'data: {broken', '', 'data: [DONE]'"
    return replies.selectExpr(
        "stream_id", f"posexplode(concat(array({role}), {texts}, array({finish}, {rest}))) AS (seq, line)"
    ).withColumn("seq", F.col("seq").cast("long"))


def reply_tokens(replies: DataFrame) -> DataFrame:
    """``stream_id, placeholder, value``: the maps of the replies as rows."""
    return reply_maps(replies).select("stream_id", F.explode("token_map").alias("placeholder", "value"))


def document_bytes(spark: SparkSession, folder: str, size: int = 997) -> DataFrame:
    """``doc_id, seq, bytes``: the texts of the documents as chunks of ``size`` bytes, cut anywhere."""
    cut = (
        f"transform(sequence(0, CAST(octet_length(text) DIV {size} AS INT)), "
        f"i -> substring(CAST(text AS BINARY), i * {size} + 1, {size}))"
    )
    return documents(spark, folder).selectExpr("doc_id", f"posexplode({cut}) AS (seq, bytes)")


def reply_chunks(replies: DataFrame, width: int = 7) -> DataFrame:
    """The replies in chunks of ``width`` characters, as chunk rows closed by a ``done`` row."""
    cut = (
        f"transform(sequence(0, CAST((length(text) - 1) DIV {width} AS INT)), "
        f"i -> substring(text, i * {width} + 1, {width}))"
    )
    chunk = replies.selectExpr("stream_id", f"posexplode({cut}) AS (seq, fragment)").selectExpr(
        "stream_id", "CAST(seq AS BIGINT) AS seq", "0 AS choice", "CAST(NULL AS INT) AS tool_idx", "fragment",
        "false AS finished", "false AS done",
    )
    ends = replies.selectExpr(
        "stream_id", f"CAST((length(text) - 1) DIV {width} + 1 AS BIGINT) AS seq", "CAST(NULL AS INT) AS choice",
        "CAST(NULL AS INT) AS tool_idx", "CAST(NULL AS STRING) AS fragment", "false AS finished", "true AS done",
    )
    return chunk.unionByName(ends)
