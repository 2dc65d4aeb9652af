"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.hof import once
from veilspark.functions.masks import mask_value
from veilspark.operators import detect as d
from veilspark.operators.admission import admit, admit_spread, rate_limit
from veilspark.operators.audit import (
    audit_events,
    audit_scopes,
    blocked_total,
    entities_total,
    rate_limited_total,
    requests_total,
    write_audit,
)
from veilspark.operators.batch import Batch, redact_batch
from veilspark.operators.chunks import rehydrate_chunks
from veilspark.operators.events import rehydrate_events
from veilspark.operators.messages import flatten_messages, reassemble_messages, rehydrate_replies, rehydrate_reply, write_back
from veilspark.operators.models import detect_with_model, join_model_spans
from veilspark.operators.overlaps import resolve_overlaps
from veilspark.operators.policy import LayeredPolicy, Policy, with_key_policy
from veilspark.operators.redact import redact, split_blocked
from veilspark.operators.rehydrate import rehydrate
from veilspark.operators.rules import compile_rules, load_rules, rules_from_json
from veilspark.operators.staging import spread, stage, staging_path
from veilspark.operators.terms import term_spans
from veilspark.operators.vault import (
    entries_from_json,
    entries_to_json,
    evict,
    later,
    live_tokens,
    lookup_as_of,
    lookup_maps,
    map_id,
    read_vault,
    rehydrate_from_rows,
    sweep_vault,
    swept_path,
    to_token_vault,
    to_vault,
    vault_size,
    write_vault,
)
from veilspark.plans import tables as t
from veilspark.plans.oracles import (
    BUCKET_LIMIT,
    BUCKET_WINDOW_MS,
    CLASSES,
    LIMIT,
    LIMIT_WINDOW_SEC,
    ONE_CALLER_LIMIT,
    ONE_CALLER_WINDOW_MS,
    VAULT_LIFE_MS,
)
from veilspark.sources.bytes import lines_of_chunks
from veilspark.sources.chunks import chunk_frames, parse_chunk_lines, read_chunk_files
from veilspark.sources.policies import checked_policies, request_policy
from veilspark.sources.text import split_overlong
from veilspark.streaming.conversations import redact_conversation_stream
from veilspark.streaming.stateful import (
    admit_stream,
    line_stream,
    rate_limit_stream,
    rehydrate_chunk_stream,
    rehydrate_event_stream,
)
from veilspark.streaming.stateless import (
    drain,
    drain_epochs,
    drain_totals,
    drain_window_counts,
    live_entity_counts,
    live_request_counts,
    read_stream,
    redact_stream,
)

Query = Callable[[SparkSession, str], DataFrame]

MIXED = Policy("redact", {"EMAIL": "mask", "PHONE": "allow", "SSN": "block"})
BLOCK_SSN = Policy("redact", {"SSN": "block"})
RULES = (
    '[{"name": "customer no", "pattern": "Customer#\\\\d{9}"},'
    ' {"name": "codename", "terms": ["maple hill", "Maple Street", "here since"], "flags": "i"}]'
)


def _ts() -> Column:
    return F.lit("2024-01-01T00:00:00Z")


def _shown(redacted: DataFrame, *ids: str) -> DataFrame:
    return redacted.select(
        *ids, "redacted", F.size("entities").cast("long").alias("n_entities"), "blocked"
    )


def _map_text(entries: Column) -> Column:
    """A token map as one string, sorted by placeholder, so that it can be compared."""
    return F.array_join(
        F.transform(F.sort_array(F.map_keys(entries)), lambda k: F.concat(k, F.lit("="), F.element_at(entries, k))),
        "|",
    )


def _counts_text(counts: Column) -> Column:
    return F.array_join(
        F.transform(
            F.sort_array(F.map_keys(counts)),
            lambda k: F.concat(k, F.lit("="), F.element_at(counts, k).cast("string")),
        ),
        ",",
    )


def _spans_out(found: DataFrame, *ids: str) -> DataFrame:
    return d.findings(found, *ids).withColumns(
        {"start": F.col("start").cast("long"), "end": F.col("end").cast("long")}
    )


def _detect(detector: d.Detector | d.ColumnDetector) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = d.detect(t.corpus(spark, sf), detectors=(detector,))
        return _spans_out(found, "src", "id").select("src", "id", "type", "start", "end", "value")

    return run


def text_scan(spark: SparkSession, sf: str) -> DataFrame:
    ok, refused = split_overlong(t.documents(spark, sf), limit=5000)
    kept = ok.select("doc_id", F.length("text").cast("long").alias("n"), F.lit("ok").alias("status"))
    return kept.unionByName(
        refused.select("doc_id", F.col("n_chars").cast("long").alias("n"), F.col("error").alias("status"))
    )


def recorded_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies recorded as files of event lines, 200 conversations each, and read again line by line."""
    replies = t.replies(spark, sf)
    part = F.floor(F.col("conv_id") / 200).cast("long").alias("part")
    lines = t.reply_lines(replies).join(replies.select("stream_id", "conv_id", "turn", part), "stream_id")
    path = staging_path(spark, "recorded")
    # The streams of a file come one after the other.
    ordered = lines.repartition("part").sortWithinPartitions("part", "conv_id", "turn", "seq")
    ordered.select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)
    read = read_chunk_files(spark, path)
    return read.select(F.regexp_extract("stream_id", r"part=(\d+)", 1).cast("long").alias("part"), "seq", "line")


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON request per message; every other message is sent in parts."""
    plain = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(
        part("text", F.col("text")), part("image", F.lit("not text")), part("text", F.lit("second part"))
    )
    listed = F.to_json(F.struct(F.array(F.struct("role", parts.alias("content"))).alias("messages")))
    return t.chats(spark, sf).select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, plain).otherwise(listed).alias("body"))


def message_flatten(spark: SparkSession, sf: str) -> DataFrame:
    flat = flatten_messages(_bodies(spark, sf), ids=("conv_id", "turn"))
    return flat.select(
        "conv_id", "turn", F.col("msg_idx").cast("long"), F.col("part_idx").cast("long"), "role", "text"
    )


def message_reassemble(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted chats put back as messages; odd turns get a second part."""
    texts = _chat_batch(spark, sf, Policy()).texts.select("conv_id", F.col("turn").alias("msg_idx"), "role", "redacted")
    odd = F.col("msg_idx") % 2 == 1
    first = texts.withColumn("part_idx", F.when(odd, 0).cast("int"))
    second = texts.where(odd).withColumn("redacted", F.lit("tail")).withColumn("part_idx", F.lit(1))
    whole = reassemble_messages(first.unionByName(second), ids=("conv_id",))
    return whole.select("conv_id", F.col("msg_idx").alias("turn"), "content")


def message_write_back(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted chats put back into requests with a name, an image part and a message without content."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("text")), part("image", F.lit("not text")))
    call = F.lit('{"role":"assistant","content":null,"tool_calls":[{"id":"c1"}]}')

    def body(content: Column) -> Column:
        own = F.to_json(F.struct("role", F.lit("ann").alias("name"), content.alias("content")))
        return F.concat(F.lit('{"model":"m","messages":['), call, F.lit(","), own, F.lit("]}"))

    chats = t.chats(spark, sf)
    sent = stage(chats.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, body(F.col("text"))).otherwise(body(parts)).alias("body")), "bodies")
    ids = ("conv_id", "turn")
    flat = flatten_messages(sent, ids=ids)
    done = redact_batch(flat, (*ids, "msg_idx"), ("conv_id",), ("turn",)).texts
    v = F.parse_json("body")
    got = lambda path: F.try_variant_get(v, path, "string")
    return write_back(sent, done, ids).select(
        *ids,
        F.coalesce(got("$.messages[1].content[0].text"), got("$.messages[1].content")).alias("redacted"),
        F.concat_ws(
            "|", got("$.model"), got("$.messages[0].role"), F.coalesce(got("$.messages[0].content"), F.lit("-")),
            got("$.messages[0].tool_calls[0].id"), got("$.messages[1].name"), got("$.messages[1].role"),
            got("$.messages[1].content[1].type"), got("$.messages[1].content[1].text"),
        ).alias("rest"),
    )


def _token_vault(spark: SparkSession, sf: str, at: int = 1704067200) -> tuple[DataFrame, DataFrame]:
    """Chats redacted per conversation, and their token rows in a written vault, written twice, as they
    are live at second ``at``. The maps of every fifth conversation expire at second 1704067200, the
    others 15 minutes later."""
    batch = _chat_batch(spark, sf, BLOCK_SSN)
    made = F.timestamp_seconds(F.lit(1704067200) - F.when(F.col("conv_id") % 5 == 0, 900).otherwise(0))
    path = staging_path(spark, "token-vault")
    rows = to_token_vault(batch.passed_tokens(), ("conv_id",), "run", made, secret="s")
    for _ in range(2):
        write_vault(rows, path)
    return batch.passed(), live_tokens(spark.read.parquet(path), F.timestamp_seconds(F.lit(at)), ("conv_id",))


def _from_token_vault(at: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        texts, tokens = _token_vault(spark, sf, at)
        restored = rehydrate_from_rows(texts, tokens, ("conv_id", "turn"), ("conv_id",), "redacted")
        return restored.select("conv_id", "turn", "restored")

    return run


def detect_all(spark: SparkSession, sf: str) -> DataFrame:
    spans = _spans_out(d.detect(t.corpus(spark, sf)), "src", "id")
    return spans.groupBy("src", "type").agg(
        F.count("*").alias("spans"), F.sum("start").alias("starts"), F.sum("end").alias("ends")
    )


def overlap_resolution(spark: SparkSession, sf: str) -> DataFrame:
    found = once(d.detect(t.notes(spark, sf)), "kept", resolve_overlaps(F.col("spans")))
    return _spans_out(found.drop("spans").withColumnRenamed("kept", "spans"), "note_id").select("note_id", "type", "start", "end", "value")


def mask_by_type(spark: SparkSession, sf: str) -> DataFrame:
    spans = _spans_out(d.detect(t.notes(spark, sf)), "note_id")
    return spans.select("note_id", "type", "value", mask_value(F.col("type"), F.col("value")).alias("masked"))


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _with_map(redact(t.documents(spark, sf)), "doc_id")


def _notes_redacted(spark: SparkSession, sf: str, **options) -> DataFrame:
    return redact(t.notes(spark, sf), policy=options.pop("policy", MIXED), **options)


def _with_map(done: DataFrame, *ids: str) -> DataFrame:
    return done.select(
        *ids, "redacted", F.size("entities").cast("long").alias("n_entities"), "blocked",
        _map_text(F.col("token_map")).alias("token_map"),
    )


def entities_report(spark: SparkSession, sf: str) -> DataFrame:
    e = _notes_redacted(spark, sf).select("note_id", F.explode("entities").alias("e"))
    return e.select(
        "note_id", "e.type", "e.label", "e.action", "e.placeholder",
        F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"),
    )


def numbering_document(spark: SparkSession, sf: str) -> DataFrame:
    return _notes_redacted(spark, sf).select("note_id", F.explode("token_map").alias("placeholder", "value"))


def rehydrate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Redact and restore the whole corpus; the text must come back unchanged."""
    done = redact(t.corpus(spark, sf).withColumn("original", F.col("text")))
    restored = rehydrate(F.col("redacted"), F.col("token_map"))
    return done.select("src", "id", restored.alias("restored"), "original").select(
        "src", "id", "restored", (F.col("restored") == F.col("original")).alias("same")
    )


def block_split(spark: SparkSession, sf: str) -> DataFrame:
    passed, quarantine = split_blocked(stage(_notes_redacted(spark, sf), "redacted"), "note_id")
    return passed.select("note_id", F.lit("passed").alias("output"), "redacted").unionByName(
        quarantine.select(
            "note_id", F.lit("quarantine").alias("output"), F.lit(None).cast("string").alias("redacted")
        )
    )


KEY_POLICIES = {
    0: '{"default": "mask", "overrides": {"PHONE": "allow"}}',
    1: '{"default": "redact"}',
    2: '{"default": "redact", "overrides": {"SSN": "allow", "NAME": "mask"}}',
    3: '{"default": "redact", "overrides": {"EMAIL": "mask"}}',
}


def _tenant_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Policy rows for all nations, by the remainder of their key."""
    spec = F.element_at(
        F.create_map(*(F.lit(x) for kv in KEY_POLICIES.items() for x in kv)), F.col("n_nationkey") % 4
    )
    parsed = F.from_json(spec, "struct<default:string,overrides:map<string,string>>")
    return checked_policies(
        t.table(spark, sf, "nation").select(
            F.col("n_nationkey").cast("string").alias("scope_key"),
            parsed["default"].alias("default_action"),
            parsed["overrides"].alias("overrides"),
        )
    )


def _keyed_notes(spark: SparkSession, sf: str) -> DataFrame:
    keyed = t.notes(spark, sf).withColumn("api_key", F.col("tenant").cast("string"))
    return with_key_policy(keyed, _tenant_policies(spark, sf), "api_key")


def policy_by_key(spark: SparkSession, sf: str) -> DataFrame:
    policy = LayeredPolicy(Policy("redact", {"SSN": "block"}), key="key_policy")
    return _shown(redact(_keyed_notes(spark, sf), policy=policy), "note_id")


def policy_many_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The same keys and policies, taken for too many to broadcast."""
    keyed = t.notes(spark, sf).withColumn("api_key", F.col("tenant").cast("string"))
    known = with_key_policy(keyed, _tenant_policies(spark, sf), "api_key", max_rows=0)
    policy = LayeredPolicy(Policy("redact", {"SSN": "block"}), key="key_policy")
    return _shown(redact(known, policy=policy), "note_id")


def policy_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by turns: a default with an override, an override only, no policy of their own."""
    sent = F.when(F.col("note_id") % 3 == 0, '{"default": "mask", "overrides": {"PHONE": "allow"}}').when(
        F.col("note_id") % 3 == 1, '{"overrides": {"EMAIL": "block"}}'
    )
    notes = _keyed_notes(spark, sf).withColumn("sent", sent)
    layered = notes.withColumn("request_policy", request_policy("sent"))
    policy = LayeredPolicy(Policy("redact", {"SSN": "block"}), request="request_policy", key="key_policy")
    return _shown(redact(layered, policy=policy), "note_id")


def policy_function(spark: SparkSession, sf: str) -> DataFrame:
    def resolve(kind: str) -> str:
        return "allow" if kind.startswith("IPV") else "mask" if kind == "DATE" else "redact"

    return _shown(_notes_redacted(spark, sf, policy=Policy.from_function(resolve)), "note_id")


def _rules(spark: SparkSession) -> list[d.Detector]:
    return compile_rules(spark, rules_from_json(RULES))


def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _with_map(
        _notes_redacted(spark, sf, policy=Policy(), detectors=d.detector_set(*_rules(spark))), "note_id"
    )


def rules_file(spark: SparkSession, sf: str) -> DataFrame:
    """The custom rules from a file of JSON lines."""
    path = staging_path(spark, "rules")
    lines = [(json.dumps(r),) for r in json.loads(RULES)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    rules = compile_rules(spark, load_rules(spark, path))
    return _with_map(_notes_redacted(spark, sf, policy=Policy(), detectors=d.detector_set(*rules)), "note_id")


def _custom(which: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = d.detect(t.notes(spark, sf), detectors=(_rules(spark)[which],))
        return _spans_out(found, "note_id").select("note_id", "label", "start", "end", "value")

    return run


def custom_pattern_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A rule whose class holds an escape and its opposite, over the documents."""
    rules = compile_rules(spark, rules_from_json(json.dumps([{"name": "any", "pattern": CLASSES}])))
    found = d.detect(t.documents(spark, sf), detectors=tuple(rules))
    return _spans_out(found, "doc_id").select("doc_id", "label", "start", "end", "value")


def _joined_notes(size: int) -> Query:
    """Every ``size`` notes joined into one long text, redacted and restored; the texts grow in number only."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        lines = F.sort_array(F.collect_list(F.struct("note_id", "text")))
        part = F.floor(F.col("note_id") / size).cast("long").alias("part")
        long = t.notes(spark, sf).groupBy(part).agg(lines.alias("l"))
        done = redact(long.select("part", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text")))
        return done.select(
            "part",
            (F.size("token_map") > 0).alias("found"),
            rehydrate(F.col("redacted"), F.col("token_map")).alias("restored"),
        )

    return run


def term_dictionary_join(spark: SparkSession, sf: str) -> DataFrame:
    ids = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = t.table(spark, sf, "part")
    lines = (
        spread(t.table(spark, sf, "lineitem").select(*ids), *ids)
        .distinct()  # lines that agree in all four have the same text
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .join(t.table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .selectExpr(*ids, "'Sent the ' || p_name || ', not ' || p_name || 's; by ' || s_name || '.' AS text")
    )
    found = term_spans(lines, ids, part.select(F.col("p_name").alias("term")), "part")
    return _spans_out(found.withColumnRenamed("term_spans", "spans"), *ids).select(*ids, "start", "end", "value")


def _model_table(notes: DataFrame) -> DataFrame:
    """What an offline model might have written: one usable span per note and one out of bounds."""
    good = notes.select("note_id", F.lit(11).alias("start"), F.lit(29).alias("end"), F.lit("NAME").alias("type"))
    bad = notes.select("note_id", F.lit(5).alias("start"), F.lit(2_000_000).alias("end"), F.lit("NAME").alias("type"))
    return good.unionByName(bad)


def model_spans(spark: SparkSession, sf: str) -> DataFrame:
    notes = t.notes(spark, sf)
    joined = join_model_spans(notes, _model_table(notes), ("note_id",))
    found = d.detect(joined, extra=("model_spans",))
    kept = once(found, "kept", resolve_overlaps(F.col("spans"))).drop("spans")
    return _spans_out(kept.withColumnRenamed("kept", "spans"), "note_id").select(
        "note_id", "type", "start", "end", "value"
    )


def redact_with_model(spark: SparkSession, sf: str) -> DataFrame:
    notes = t.notes(spark, sf)
    joined = join_model_spans(notes, _model_table(notes), ("note_id",))
    return _shown(redact(joined, model_spans=("model_spans",)), "note_id")


def redact_model_null_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every third note has no id, and neither have its spans."""
    notes = t.notes(spark, sf).withColumn("id", F.when(F.col("note_id") % 3 > 0, F.col("note_id")))
    spans = _model_table(notes.select(F.col("id").alias("note_id"))).withColumnRenamed("note_id", "id")
    return _shown(redact(join_model_spans(notes, spans, ("id",)), model_spans=("model_spans",)), "note_id")


def model_plugin(spark: SparkSession, sf: str) -> DataFrame:
    def load():
        return lambda texts: [[(11, 29), (2, 2)] for _ in texts]

    ran = detect_with_model(t.notes(spark, sf), load)
    return _shown(redact(ran, model_spans=("model_spans",)), "note_id")


def column_plugin(spark: SparkSession, sf: str) -> DataFrame:
    """A plug-in detector written as a column expression."""

    def first_word(text: Column) -> Column:
        found = F.array(F.struct(F.lit(0).alias("start"), F.lit(7).alias("end")))
        return F.when(text.startswith("Account"), found)

    plugin = d.ColumnDetector("CUSTOM", first_word, "account")
    return _shown(redact(t.notes(spark, sf), detectors=d.detector_set(plugin)), "note_id")


def _chat_batch(spark: SparkSession, sf: str, policy: Policy) -> Batch:
    return redact_batch(t.chats(spark, sf), ("conv_id", "turn"), ("conv_id",), ("turn",), policy=policy)


def _table_batch(spark: SparkSession, sf: str) -> Batch:
    whole = t.chats(spark, sf).withColumn("scope", F.lit("all"))
    return redact_batch(whole, ("conv_id", "turn"), ("scope",), ("conv_id", "turn"))


def redact_conversations(spark: SparkSession, sf: str) -> DataFrame:
    passed = _chat_batch(spark, sf, BLOCK_SSN).passed()
    return passed.select("conv_id", "turn", "redacted", F.size("entities").cast("long").alias("n_entities"))


def redact_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Chats whose turns all carry their conversation's number as id, redacted and restored."""
    done = redact_batch(t.chats(spark, sf), ("conv_id",), ("conv_id",), ("turn",))
    back = rehydrate_from_rows(done.texts, done.tokens, ("conv_id",), ("conv_id",), "redacted")
    return back.select("conv_id", "turn", "redacted", "restored")


def streaming_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The chats as a stream of four micro-batches, two turns each, the last one all later turns."""
    path, out = staging_path(spark, "chats"), staging_path(spark, "conversations")
    chats = stage(t.chats(spark, sf), "chats")
    for k in range(4):
        part = F.least(F.floor(F.col("turn") / 2), F.lit(3)) == k
        chats.where(part).write.mode("append").parquet(path)
        # What one write added, of any number of files, is one micro-batch.
        stream = spark.readStream.schema(chats.schema).parquet(path)
        done = drain(redact_conversation_stream(stream, ("conv_id",), ("turn",)), "conversations", out)
    return done.select("conv_id", "turn", "redacted", F.size("entities").cast("long").alias("n_entities"))


def redact_null_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Every third conversation has no scope of its own; together they are one."""
    chats = t.chats(spark, sf).withColumn("scope", F.when(F.col("conv_id") % 3 > 0, F.col("conv_id")))
    done = redact_batch(chats, ("conv_id", "turn"), ("scope",), ("conv_id", "turn"))
    return done.texts.select("conv_id", "turn", "redacted", F.size("entities").cast("long").alias("n_entities"))


def numbering_conversation(spark: SparkSession, sf: str) -> DataFrame:
    return _chat_batch(spark, sf, Policy()).tokens.select("conv_id", "placeholder", "value")


def numbering_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table_batch(spark, sf).tokens.select("placeholder", "value")


def redact_table_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_table_batch(spark, sf).texts, "conv_id", "turn")


def rehydrate_table_scope(spark: SparkSession, sf: str) -> DataFrame:
    batch = _table_batch(spark, sf)
    texts = batch.texts.select("conv_id", "turn", "scope", F.col("redacted").alias("text"))
    return rehydrate_from_rows(texts, batch.tokens, ("conv_id", "turn"), ("scope",)).select(
        "conv_id", "turn", "restored"
    )


def _reply_bodies(replies: DataFrame) -> DataFrame:
    call = F.struct(F.struct(F.lit('{"to":"[EMAIL_1]"}').alias("arguments")).alias("function"))
    message = F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls"))
    body = F.to_json(F.struct(F.lit("[EMAIL_1]").alias("id"), F.array(F.struct(message.alias("message"))).alias("choices")))
    return replies.withColumn("reply", body)


def _reply_shown(done: DataFrame) -> DataFrame:
    return done.select(
        "stream_id",
        F.get_json_object("reply", "$.choices[0].message.content").alias("content"),
        F.get_json_object("reply", "$.choices[0].message.tool_calls[0].function.arguments").alias("arguments"),
        F.get_json_object("reply", "$.id").alias("id"),
    )


def reply_rehydration(spark: SparkSession, sf: str) -> DataFrame:
    """Replies as JSON, with a tool call and an id that must stay as it is."""
    replies = t.replies(spark, sf)
    sent = _reply_bodies(replies).join(t.reply_maps(replies), "stream_id")
    return _reply_shown(sent.select("stream_id", rehydrate_reply(F.col("reply"), F.col("token_map")).alias("reply")))


def reply_token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same replies restored from token rows, as the vault holds them."""
    replies = t.replies(spark, sf)
    done = rehydrate_replies(_reply_bodies(replies), t.reply_tokens(replies), ("stream_id",))
    return _reply_shown(done.select("stream_id", F.col("restored").alias("reply")))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_events(_notes_redacted(spark, sf), "note_id", "/v1/redact", _ts())


def _chat_audit(spark: SparkSession, sf: str) -> DataFrame:
    texts = _chat_batch(spark, sf, BLOCK_SSN).texts
    return audit_scopes(texts, ("conv_id",), F.col("conv_id"), "/v1/chat/completions", _ts())


def _audit_shown(events: DataFrame) -> DataFrame:
    return events.withColumn("entity_counts", _counts_text(F.col("entity_counts")))


def audit_file_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "audit")
    events = _audit(spark, sf)
    write_audit(events, "file", path)
    return _audit_shown(spark.read.schema(events.schema).json(path))


def query_requests_total(spark: SparkSession, sf: str) -> DataFrame:
    return requests_total(_audit(spark, sf).unionByName(_chat_audit(spark, sf)))


def admission(spark: SparkSession, sf: str) -> DataFrame:
    done = admit(t.requests(spark, sf).drop("ts"), BUCKET_LIMIT, BUCKET_LIMIT / BUCKET_WINDOW_MS)
    return done.withColumn("remaining", F.col("remaining").cast("long"))


def rate_limit_routes(spark: SparkSession, sf: str) -> DataFrame:
    done = rate_limit(t.requests(spark, sf).drop("ts"), LIMIT, LIMIT_WINDOW_SEC)
    return done.select("request_id", "allowed", "retry_after_ms", "retry_after_sec")


def _request_stream(spark: SparkSession, sf: str) -> DataFrame:
    source = read_stream(spark, sf, "events.parquet", t.table(spark, sf, "events").schema)
    return source.selectExpr(
        "CAST(user_id AS STRING) AS caller",
        "event_id AS request_id",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms",
        "CASE event_type WHEN 'error' THEN '/health' WHEN 'click' THEN '/v1/redact' "
        "ELSE '/v1/chat/completions' END AS route",
    )


def rate_limit_stream_routes(spark: SparkSession, sf: str) -> DataFrame:
    done = drain(rate_limit_stream(_request_stream(spark, sf), LIMIT, LIMIT_WINDOW_SEC), "limits")
    return done.select("request_id", "allowed", "retry_after_ms", "retry_after_sec")


def admission_one_caller(spark: SparkSession, sf: str) -> DataFrame:
    """All requests are one caller's; eight in twelve hours pass."""
    one = t.requests(spark, sf).withColumn("caller", F.lit("all")).drop("ts")
    done = admit_spread(one, ONE_CALLER_LIMIT, ONE_CALLER_WINDOW_MS)
    return done.select("request_id", "allowed", "retry_after_ms", F.col("remaining").cast("long").alias("remaining"))


def streaming_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events of a document stream, every micro-batch committed once."""
    source = _document_stream(spark, sf).withColumnRenamed("doc_id", "id")
    events = audit_events(redact_stream(source), "id", "/v1/redact", _ts())
    return _audit_shown(drain_epochs(events, staging_path(spark, "audit")))


def streaming_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    source = read_stream(spark, sf, "events.parquet", t.table(spark, sf, "events").schema)
    requests = source.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("route"))
    done = drain_window_counts(requests, staging_path(spark, "windows"))
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "route", "requests")


def admission_null_callers(spark: SparkSession, sf: str) -> DataFrame:
    """Every third request has no caller; these share one bucket."""
    caller = F.when(F.col("request_id") % 3 > 0, F.col("caller"))
    done = admit(t.requests(spark, sf).withColumn("caller", caller).drop("ts"), BUCKET_LIMIT, BUCKET_LIMIT / BUCKET_WINDOW_MS)
    return done.select("request_id", "allowed", "retry_after_ms")


def admission_stream(spark: SparkSession, sf: str) -> DataFrame:
    requests = _request_stream(spark, sf)
    done = drain(admit_stream(requests, BUCKET_LIMIT, BUCKET_LIMIT / BUCKET_WINDOW_MS), "admission")
    return done.withColumn("remaining", F.col("remaining").cast("long"))


def chunk_rehydration(spark: SparkSession, sf: str) -> DataFrame:
    replies = t.replies(spark, sf)
    done = rehydrate_chunks(t.reply_chunks(replies), t.reply_maps(replies))
    return done.select("stream_id", "seq", "text", "flushed")


def chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    source = read_stream(spark, sf, "conversations.parquet", t.table(spark, sf, "conversations").schema)
    replies = source.selectExpr("conv_id || ':' || turn AS stream_id", f"{t.reply_text()} AS text")
    maps = t.reply_maps(t.replies(spark, sf))
    done = drain(rehydrate_chunk_stream(t.reply_chunks(replies), maps), "chunks")
    return done.select("stream_id", "seq", "text", "flushed")


def query_chunk_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Rehydrated replies written out as event lines."""
    replies = t.replies(spark, sf)
    chunks = t.reply_chunks(replies)
    frames = chunk_frames(rehydrate_chunks(chunks, t.reply_maps(replies)), chunks)
    return frames.withColumn("part", F.col("part").cast("long"))


def _event_shown(frames: DataFrame) -> DataFrame:
    """What a reader takes from each line; the line itself where it holds no content."""
    v = F.try_parse_json(F.substring("line", 7, 2_000_000_000))
    got = lambda path: F.try_variant_get(v, path, "string")
    shown = frames.select(
        "stream_id", "seq", F.col("part").cast("long").alias("part"), got("$.id").alias("id"),
        got("$.choices[0].delta.content").alias("content"), got("$.choices[0].finish_reason").alias("finish"), "line",
    )
    return shown.withColumn("line", F.when(F.col("content").isNull(), F.col("line")))


def event_write_back(spark: SparkSession, sf: str) -> DataFrame:
    """Replies received as event lines, with ids, models, finish reasons, usage and broken lines."""
    replies = t.replies(spark, sf)
    return _event_shown(rehydrate_events(t.reply_lines(replies), t.reply_maps(replies)))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    source = read_stream(spark, sf, "conversations.parquet", t.table(spark, sf, "conversations").schema)
    replies = source.selectExpr("conv_id", "turn", "conv_id || ':' || turn AS stream_id", f"{t.reply_text()} AS text")
    # A reply becomes a hundred lines, so replies are dealt before. Those of one stream stay in their order, and
    # with no fewer tasks than a join has their lines are not dealt again to meet the maps.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    replies = replies.repartition(tasks, "stream_id")
    # Every micro-batch joins the maps: they are made once.
    maps = stage(t.reply_maps(t.reply_keys(spark, sf)), "maps")
    return _event_shown(drain(rehydrate_event_stream(t.reply_lines(replies), maps), "events"))


def chunk_token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks restored from token rows, as the vault holds them."""
    replies = t.replies(spark, sf)
    done = rehydrate_chunks(t.reply_chunks(replies), tokens=t.reply_tokens(replies))
    return done.select("stream_id", "seq", "text", "flushed")


def byte_chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The documents sent as byte chunks, cut anywhere, and put together to lines."""
    return lines_of_chunks(t.document_bytes(spark, sf), ("doc_id",))


def byte_chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    chunks = read_stream(spark, sf, "documents.parquet", t.table(spark, sf, "documents").schema).selectExpr(
        "CAST(doc_id AS STRING) AS stream_id",
        "posexplode(transform(sequence(0, CAST(octet_length(text) DIV 997 AS INT)), "
        "i -> substring(CAST(text AS BINARY), i * 997 + 1, 997))) AS (seq, bytes)",
        "octet_length(text) DIV 997 AS final",
    ).withColumn("last", F.col("seq") == F.col("final"))
    done = drain(line_stream(chunks), "lines")
    return done.select(F.col("stream_id").cast("long").alias("doc_id"), "line_no", "line")


def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk rows written out as event lines and parsed back, with a broken and a tool-call line."""
    replies = t.replies(spark, sf)
    delta = F.struct(F.lit(0).alias("index"), F.struct(F.col("fragment").alias("content")).alias("delta"))
    frame = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(delta).alias("choices"))))
    chunks = t.reply_chunks(replies)
    lines = chunks.select(
        "stream_id", "seq", F.when(F.col("done"), F.lit("data: [DONE]")).otherwise(frame).alias("line")
    )
    after = replies.selectExpr("stream_id", "CAST((length(text) - 1) DIV 7 AS BIGINT) AS n")
    tool = (
        'data:{"choices":[{"index":1,"finish_reason":"tool_calls","delta":{"tool_calls":'
        '[{"index":2,"function":{"arguments":"[EMAIL_1]"}}]}}]}'
    )
    more = after.select(
        "stream_id",
        F.posexplode(F.array(F.lit("data: {broken"), F.lit(tool), F.lit(": comment"), F.lit(""))).alias("i", "line"),
        "n",
    ).select("stream_id", (F.col("n") + 2 + F.col("i")).alias("seq"), "line")
    rows = parse_chunk_lines(lines.unionByName(more))
    return rows.withColumns({"choice": F.col("choice").cast("long"), "tool_idx": F.col("tool_idx").cast("long")})


def _vault(spark: SparkSession, sf: str, writes: int = 1) -> tuple[DataFrame, DataFrame, Column]:
    """Notes redacted and put in a written vault; every fifth map is already expired at ``now``."""
    done = stage(redact(t.notes(spark, sf)), "redacted")
    made = F.when(F.col("note_id") % 5 == 0, F.timestamp_seconds(F.lit(1704067200 - 900))).otherwise(
        F.timestamp_seconds(F.lit(1704067200))
    )
    path = staging_path(spark, "vault")
    for _ in range(writes):
        write_vault(to_vault(done, "note_id", "run", made), path)
    texts = done.select("note_id", F.col("redacted").alias("text"), map_id("run", F.col("note_id")).alias("map_id"))
    return texts, read_vault(spark, path), F.timestamp_seconds(F.lit(1704067200))


def vault_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    texts, vault, now = _vault(spark, sf)
    serialized = vault.withColumn("entries", entries_from_json(entries_to_json(F.col("entries"))))
    found, _ = lookup_maps(texts, serialized, now)
    return found.select("note_id", rehydrate(F.col("text"), F.col("token_map")).alias("restored"))


def vault_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """A run that wrote its vault twice restores every text once."""
    found, _ = lookup_maps(*_vault(spark, sf, writes=2))
    return found.select("note_id", rehydrate(F.col("text"), F.col("token_map")).alias("restored"))


def vault_misses(spark: SparkSession, sf: str) -> DataFrame:
    texts, vault, now = _vault(spark, sf)
    _, missing = lookup_maps(texts, vault, now)
    return missing.select("note_id", "error")


def query_vault_size(spark: SparkSession, sf: str) -> DataFrame:
    _, vault, now = _vault(spark, sf)
    return vault_size(vault, now)


def vault_swept(spark: SparkSession, sf: str) -> DataFrame:
    """A vault written twice and swept: expired maps are gone, others are there once."""
    path = staging_path(spark, "swept")
    _, vault, now = _vault(spark, sf, writes=2)
    sweep_vault(spark, vault, path, now)
    again = sweep_vault(spark, read_vault(spark, swept_path(spark, path)), path, now)
    kept = read_vault(spark, again)
    return kept.select(F.col("scope_id").cast("long").alias("note_id"), F.size("entries").cast("long").alias("n_tokens"))


def vault_lifetimes(spark: SparkSession, sf: str) -> DataFrame:
    """A map per event in a vault of 100 maps and a lifetime, asked for at four times after its event."""
    made = t.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    entries = F.create_map(F.lit("[A_1]"), F.col("event_id").cast("string"))
    vault = made.select(
        map_id("run", F.col("event_id")).alias("map_id"), entries.alias("entries"), "created_at",
        later(F.col("created_at"), VAULT_LIFE_MS).alias("expires_at"),
    )
    asked = made.select(
        "event_id", map_id("run", F.col("event_id")).alias("map_id"), "created_at",
        F.explode(F.array(*(F.lit(k).cast("long") for k in range(4)))).alias("k"),
    ).withColumn("at", F.timestamp_micros(F.unix_micros("created_at") + F.col("k") * F.lit(VAULT_LIFE_MS * 480)))
    return lookup_as_of(asked, vault, "at", 100).select("event_id", "k", F.col("token_map").isNotNull().alias("found"))


def vault_eviction(spark: SparkSession, sf: str) -> DataFrame:
    """A vault with one map per event, cut to its newest 500."""
    events = t.table(spark, sf, "events").select(
        map_id("run", F.col("event_id")).alias("map_id"),
        F.col("event_id").cast("string").alias("scope_id"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("created_at"),
    )
    return evict(events, 500).select("scope_id")


def _document_stream(spark: SparkSession, sf: str) -> DataFrame:
    source = read_stream(spark, sf, "documents.parquet", t.table(spark, sf, "documents").schema)
    return source.select("doc_id", "text")


def streaming_redaction(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(drain(redact_stream(_document_stream(spark, sf)), "redacted"), "doc_id")


def streaming_entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return drain_totals(live_entity_counts(redact_stream(_document_stream(spark, sf))), "entities")


def streaming_request_counts(spark: SparkSession, sf: str) -> DataFrame:
    blocked = Policy("redact", {"IPV4": "block"})
    done = redact_stream(_document_stream(spark, sf), policy=blocked)
    return drain_totals(live_request_counts(done, "/v1/redact"), "requests")


def queries() -> dict[str, Query]:
    return {
        "text_scan": text_scan,
        "recorded_replies": recorded_replies,
        "message_flatten": message_flatten,
        "message_reassemble": message_reassemble,
        "message_write_back": message_write_back,
        "custom_pattern_classes": custom_pattern_classes,
        "redact_long_texts": _joined_notes(1000),
        "redact_joined_notes": _joined_notes(500),
        # Live and expired conversations in one lookup; all live; all expired.
        "token_vault_all": _from_token_vault(1704067200),
        "chat_round_trip": _from_token_vault(1704067199),
        "token_vault_expiry": _from_token_vault(1704068100),
        **{f"detect_{x.type.lower()}": _detect(x) for x in d.BUILT_IN},
        "detect_card_subspan": _detect(d.CREDIT_CARD_SUBSPAN),
        "detect_all": detect_all,
        "overlap_resolution": overlap_resolution,
        "mask_by_type": mask_by_type,
        "redact_documents": redact_documents,
        "redact_notes": lambda spark, sf: _with_map(_notes_redacted(spark, sf), "note_id"),
        "redact_pages": lambda spark, sf: _shown(redact(t.pages(spark, sf)), "page_id"),
        "entities_report": entities_report,
        "numbering_document": numbering_document,
        "rehydrate_documents": rehydrate_documents,
        "block_split": block_split,
        "policy_by_key": policy_by_key,
        "policy_layers": policy_layers,
        "policy_function": policy_function,
        "custom_rules": custom_rules,
        "rules_file": rules_file,
        "detect_api_key_assigned": _detect(d.API_KEY_ASSIGNED),
        "policy_many_keys": policy_many_keys,
        "custom_pattern": _custom(0),
        "custom_terms": _custom(1),
        "term_dictionary_join": term_dictionary_join,
        "model_spans": model_spans,
        "redact_with_model": redact_with_model,
        "redact_model_null_ids": redact_model_null_ids,
        "model_plugin": model_plugin,
        "column_plugin": column_plugin,
        "redact_conversations": redact_conversations,
        "numbering_conversation": numbering_conversation,
        "numbering_table": numbering_table,
        "redact_table_scope": redact_table_scope,
        "rehydrate_table_scope": rehydrate_table_scope,
        "reply_rehydration": reply_rehydration,
        "audit_events": lambda spark, sf: _audit_shown(_audit(spark, sf)),
        "audit_file_sink": audit_file_sink,
        "audit_conversations": lambda spark, sf: _audit_shown(_chat_audit(spark, sf)),
        "requests_total": query_requests_total,
        "entities_total": lambda spark, sf: entities_total(_notes_redacted(spark, sf)),
        "blocked_total": lambda spark, sf: blocked_total(_audit(spark, sf)),
        "rate_limited_total": lambda spark, sf: rate_limited_total(admission(spark, sf)),
        "admission": admission,
        "admission_stream": admission_stream,
        "admission_null_callers": admission_null_callers,
        "admission_one_caller": admission_one_caller,
        "streaming_audit": streaming_audit,
        "streaming_window_counts": streaming_window_counts,
        "rate_limit_stream": rate_limit_stream_routes,
        "rate_limit_routes": rate_limit_routes,
        "chunk_rehydration": chunk_rehydration,
        "chunk_stream": chunk_stream,
        "chunk_lines": chunk_lines,
        "chunk_frames": query_chunk_frames,
        "event_write_back": event_write_back,
        "event_stream": event_stream,
        "chunk_token_rows": chunk_token_rows,
        "reply_token_rows": reply_token_rows,
        "byte_chunk_lines": byte_chunk_lines,
        "byte_chunk_stream": byte_chunk_stream,
        "vault_rewritten": vault_rewritten,
        "redact_null_scopes": redact_null_scopes,
        "redact_repeated_ids": redact_repeated_ids,
        "vault_round_trip": vault_round_trip,
        "vault_misses": vault_misses,
        "vault_size": query_vault_size,
        "vault_eviction": vault_eviction,
        "vault_swept": vault_swept,
        "vault_lifetimes": vault_lifetimes,
        "streaming_conversations": streaming_conversations,
        "streaming_redaction": streaming_redaction,
        "streaming_entity_counts": streaming_entity_counts,
        "streaming_request_counts": streaming_request_counts,
    }
