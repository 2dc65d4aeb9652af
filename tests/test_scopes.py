"""Batch scopes, lookups, numbering, messages, vault, models and terms."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import lookup, numbering
from veilspark.operators import terms as terms_module
from veilspark.operators.admission import caller_of
from veilspark.operators.audit import audit_scopes, write_audit
from veilspark.operators.batch import redact_batch
from veilspark.operators.detect import API_KEY_ASSIGNED, detect
from veilspark.operators.lookup import attach_values
from veilspark.operators.messages import flatten_messages, reassemble_messages, rehydrate_reply
from veilspark.operators.models import detect_with_model, join_model_spans, parse_spans
from veilspark.operators.policy import Policy, with_key_policy
from veilspark.operators.redact import redact
from veilspark.operators.rehydrate import rehydrate
from veilspark.operators.rules import compile_rules, load_rules
from veilspark.operators.staging import stage
from veilspark.operators.terms import term_spans
from veilspark.operators.vault import (
    entries_from_json,
    evict,
    live,
    lookup_maps,
    read_vault,
    rehydrate_from_rows,
    to_vault,
    vault_size,
    write_vault,
)
from veilspark.sources.chunks import read_chunk_files
from veilspark.sources.text import read_texts, split_overlong


def batch_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    return redact_batch(df, ("conv_id", "turn"), ("conv_id",), ("turn",), **options)


def test_conversation_scope(spark):
    b = batch_of(spark, [(1, 0, "mail a@b.com"), (1, 1, "again a@b.com and c@d.com"), (2, 0, "c@d.com"), (2, 1, "none")])
    got = {(r.conv_id, r.turn): r.redacted for r in b.texts.collect()}
    assert got == {
        (1, 0): "mail [EMAIL_1]", (1, 1): "again [EMAIL_1] and [EMAIL_2]", (2, 0): "[EMAIL_1]", (2, 1): "none"
    }
    assert {(r.conv_id, r.placeholder): r.value for r in b.tokens.collect()} == {
        (1, "[EMAIL_1]"): "a@b.com", (1, "[EMAIL_2]"): "c@d.com", (2, "[EMAIL_1]"): "c@d.com"
    }


def test_blocked_text_holds_back_its_conversation(spark):
    rows = [(1, 0, "a@b.com"), (1, 1, "ssn 123-45-6789"), (2, 0, "hi")]
    b = batch_of(spark, rows, policy=Policy("redact", {"SSN": "block"}))
    assert [(r.conv_id, r.redacted) for r in b.passed().collect()] == [(2, "hi")]
    assert b.passed_tokens().count() == 0
    events = audit_scopes(b.texts, ("conv_id",), F.col("conv_id"), "/chat", F.lit("t")).collect()
    assert {e.request_id: (e.blocked, e.entity_counts, e.total_entities) for e in events} == {
        "1": (True, {"EMAIL": 1, "SSN": 1}, 2), "2": (False, {}, 0)
    }


def brute_numbers(rows):
    seen, counts, out = {}, {}, {}
    for scope, order, start, display, value in sorted(rows):
        key = (scope, display, value)
        if key not in seen:
            counts[scope, display] = counts.get((scope, display), 0) + 1
            seen[key] = out[key] = f"[{display}_{counts[scope, display]}]"
    return out


@pytest.mark.parametrize("spread_bits", [0, 10, 30, 50])
def test_numbering_over_bucket_levels(spark, spread_bits):
    """Order keys far apart need several levels; the numbers must not depend on it."""
    rng = random.Random(spread_bits)
    rows = [
        (rng.choice("ab"), (rng.randrange(400) << spread_bits) - 50, rng.randrange(5), rng.choice(["E", "P"]), f"v{rng.randrange(150)}")
        for _ in range(1500)
    ]
    df = spark.createDataFrame(rows, "scope string, pos long, start int, display string, value string")
    values = stage(numbering.distinct_values(df, ["scope"], ["pos", "start"]))
    # A tie in position between two values is broken by the value.
    got = {(r.scope, r.display, r.value): r.placeholder for r in numbering.number_values(values, ["scope"], ["pos", "start"]).collect()}
    assert got == brute_numbers(rows)


def test_hot_keys_take_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MIN_HOT", 20)
    monkeypatch.setattr(lookup, "HOT_KEYS", 4)
    rows = [(i, 0, ["hot", f"k{i % 50}"] if i % 3 else ["hot"]) for i in range(300)] + [(300, 0, []), (301, 0, ["unknown"])]
    df = spark.createDataFrame(rows, "id int, scope int, keys array<string>")
    table = spark.createDataFrame([(0, "hot", "H")] + [(0, f"k{i}", f"v{i}") for i in range(50)], "scope int, k string, v string")
    df = stage(lookup.numbered_rows(df))
    got = {r.id: r.m for r in attach_values(df, "keys", table, ["scope"], "k", "v", "m").collect()}
    assert len(got) == 302 and got[300] is None and not got[301]
    for i in range(300):
        assert got[i] == ({"hot": "H", f"k{i % 50}": f"v{i % 50}"} if i % 3 else {"hot": "H"})


def test_table_scope_round_trip(spark):
    rows = [(i, 0, f"x{i % 9}@y.com and 415-555-{i % 4:04d}") for i in range(80)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("scope", F.lit(1))
    b = redact_batch(df, ("conv_id", "turn"), ("scope",), ("conv_id", "turn"))
    assert b.tokens.count() == 13
    texts = b.texts.withColumnRenamed("redacted", "text").select("conv_id", "turn", "scope", "text")
    back = rehydrate_from_rows(texts, b.tokens, ("conv_id", "turn"), ("scope",))
    assert {r.conv_id: r.restored for r in back.collect()} == {i: t for i, _, t in rows}


def test_rehydrate(spark):
    m = {"[EMAIL_1]": "[EMAIL_11]", "[EMAIL_11]": "b", "[N_1]": 'q"\\'}
    df = spark.createDataFrame([("[EMAIL_1] [EMAIL_11] [SSN_9] [note 1] [[N_1]]", m), ("x", m), ("[N_1]", None)], "t string, m map<string,string>")
    got = df.select(rehydrate(F.col("t"), F.col("m")).alias("a"), rehydrate(F.col("t"), F.col("m"), True).alias("b")).collect()
    assert got[0].a == '[EMAIL_11] b [SSN_9] [note 1] [q"\\]'
    assert got[0].b == '[EMAIL_11] b [SSN_9] [note 1] [q\\"\\\\]'
    assert got[1].a == "x" and got[2].a == "[N_1]"


def test_messages(spark):
    body = {"messages": [
        {"role": "user", "content": "hi a@b.com"},
        {"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image", "text": "no"}, {"type": "text", "text": 5}, "s", {"type": "text", "text": "y"}]},
        {"role": "a", "content": None}, {"role": "q"}, {"content": 7}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{bad"), (3, "{}")], "conv_id int, body string")
    flat = flatten_messages(df)
    got = [(r.conv_id, r.msg_idx, r.part_idx, r.text) for r in flat.orderBy("msg_idx", "part_idx").collect()]
    assert got == [(1, 0, None, "hi a@b.com"), (1, 1, 0, "x"), (1, 1, 4, "y")]
    back = {r.msg_idx: r.content for r in reassemble_messages(flat.withColumnRenamed("text", "redacted")).collect()}
    assert back[0] == "hi a@b.com" and json.loads(back[1]) == [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]


def test_replies(spark):
    reply = {"id": "[E_1]", "usage": {"n": 1.5}, "choices": [
        {"index": 0, "message": {"role": "assistant", "content": "to [E_1]", "tool_calls": [
            {"id": "c", "function": {"name": "f", "arguments": '{"to":"[E_1]"}'}}, {"id": "d"}]}},
        {"index": 1, "finish_reason": "stop", "message": {"content": [{"type": "text", "text": "a [E_1]"}, {"type": "img"}]}},
        {"index": 2}]}
    m = {"[E_1]": 'j"x@a.co'}
    df = spark.createDataFrame([(1, json.dumps(reply), m), (2, "not json", m), (3, '{"choices": 1}', m)], "id int, r string, m map<string,string>")
    got = {r.id: (r.a, r.b) for r in df.select("id", rehydrate_reply(F.col("r"), F.col("m")).alias("a"), rehydrate_reply(F.col("r"), F.col("m"), True).alias("b")).collect()}
    want = json.loads(json.dumps(reply))
    want["choices"][0]["message"]["content"] = 'to j"x@a.co'
    want["choices"][1]["message"]["content"][0]["text"] = 'a j"x@a.co'
    want["choices"][0]["message"]["tool_calls"][0]["function"]["arguments"] = '{"to":"j"x@a.co"}'
    assert json.loads(got[1][0]) == want
    args = json.loads(got[1][1])["choices"][0]["message"]["tool_calls"][0]["function"]["arguments"]
    assert json.loads(args) == {"to": 'j"x@a.co'}
    assert got[2][0] == "not json" and got[3][0] == '{"choices": 1}'


def test_vault(spark, tmp_path):
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    done = redact(spark.createDataFrame([(1, "a@b.com"), (2, "ssn 123-45-6789")], "id int, text string"), policy=Policy("redact", {"SSN": "block"}))
    path = str(tmp_path / "vault")
    write_vault(to_vault(done, "id", "r1", at(0), ttl_ms=60_000), path)
    vault = read_vault(spark, path)
    row = vault.collect()
    assert len(row) == 1 and row[0].entries == {"[EMAIL_1]": "a@b.com"}
    assert live(vault, at(59_999)).count() == 1 and live(vault, at(60_000)).count() == 0
    assert vault_size(vault, at(1)).first().size == 1
    texts = spark.createDataFrame(
        [(1, "[EMAIL_1]", row[0].map_id, None), (2, "[X_1]", None, {"[X_1]": "y"}), (3, "z", "nope", None), (4, "z", None, None)],
        "id int, text string, map_id string, given map<string,string>",
    )
    found, missing = lookup_maps(texts, vault, at(1), inline="given")
    assert {r.id: r.t for r in found.select("id", rehydrate(F.col("text"), F.col("token_map")).alias("t")).collect()} == {1: "a@b.com", 2: "y"}
    assert sorted((r.id, r.error) for r in missing.collect()) == [(3, "missing_token_map"), (4, "missing_token_map")]
    assert sorted(r.id for r in lookup_maps(texts, vault, at(60_001))[1].collect()) == [1, 2, 3, 4]
    raw = spark.createDataFrame([('{"entries":{"[A_1]":"x"}}',), ("{corrupt",), ("null",)], "j string")
    assert [r[0] for r in raw.select(entries_from_json(F.col("j"))).collect()] == [{"[A_1]": "x"}, None, None]


def test_eviction(spark):
    rows = [(f"m{i}", i) for i in range(3)]
    df = spark.createDataFrame(rows, "map_id string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    assert sorted(r.map_id for r in evict(df, 2).collect()) == ["m1", "m2"]


def test_model_spans(spark):
    texts = spark.createDataFrame([(1, "hi Zephyr! a@b.com"), (2, "none")], "id int, text string")
    spans = spark.createDataFrame([(1, 3, 9), (1, 5, 999), (1, 2, 2), (1, -1, 2)], "id int, start int, end int")
    done = redact(join_model_spans(texts, spans, ("id",)), model_spans=("model_spans",))
    assert {r.id: r.redacted for r in done.collect()} == {1: "hi [NAME_1]! [EMAIL_1]", 2: "none"}
    custom = join_model_spans(texts, spans, ("id",), kind="CUSTOM").where("id = 1").first()
    assert [s.type for s in custom.model_spans] == ["CUSTOM"]


def test_model_spans_of_texts_without_an_id(spark):
    texts = spark.createDataFrame([(None, "hi Zephyr ok"), (2, "by Zephyr"), (2, "or Zephyr")], "id int, text string")
    spans = spark.createDataFrame([(None, 3, 9), (None, 3, 9), (2, 3, 9)], "id int, start int, end int")
    done = redact(join_model_spans(texts, spans, ("id",)), model_spans=("model_spans",))
    assert sorted(r.redacted for r in done.collect()) == ["by [NAME_1]", "hi [NAME_1] ok", "or [NAME_1]"]


def test_repeated_and_null_ids(spark):
    """Texts that share an id and a value are redacted and restored one by one."""
    rows = [(None, 0, "a@b.com one"), (None, 1, "a@b.com two"), (7, 2, "a@b.com c@d.com"), (7, 3, "c@d.com"), (7, 4, "none")]
    df = spark.createDataFrame([(i, "s", p, x) for i, p, x in rows], "id int, scope string, pos int, text string")
    done = redact_batch(df, ["id"], ["scope"], ["pos"])
    got = {r.pos: (r.id, r.redacted) for r in done.texts.collect()}
    assert got == {
        0: (None, "[EMAIL_1] one"), 1: (None, "[EMAIL_1] two"), 2: (7, "[EMAIL_1] [EMAIL_2]"), 3: (7, "[EMAIL_2]"), 4: (7, "none"),
    }
    back = rehydrate_from_rows(done.texts, done.tokens, ["id"], ["scope"], "redacted")
    assert {r.pos: r.restored for r in back.collect()} == {p: x for _, p, x in rows}
    assert set(back.columns) == {*done.texts.columns, "restored"}


def test_model_replies(spark):
    rows = [('{"spans": [{"start": 3, "end": 9, "label": "PERSON"}, {"start": "x", "end": 2}]}',), ("[]",), ("{}",), ("nope",), ('[{"start": 0, "end": 2}]',)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(parse_spans(F.col("j"))).collect()]
    assert [(s.start, s.end) for s in got[0]][0] == (3, 9) and got[0][1].start is None
    assert got[1] == [] and got[2] == [] and got[3] is None and [(s.start, s.end) for s in got[4]] == [(0, 2)]


def test_model_plugin(spark):
    def finder():
        return lambda texts: [[m.span() for m in re.finditer("Zephyr", t)] for t in texts]

    def broken():
        raise OSError("secret text")

    texts = spark.createDataFrame([(1, "Zephyr and Zephyr"), (2, "x")], "id int, text string")
    done = redact(detect_with_model(texts, finder), model_spans=("model_spans",))
    assert {r.id: r.redacted for r in done.collect()} == {1: "[NAME_1] and [NAME_1]", 2: "x"}
    assert all(r.model_spans == [] for r in detect_with_model(texts, broken).collect())
    with pytest.raises(Exception, match="model detection failed") as e:
        detect_with_model(texts, broken, on_error="throw").collect()
    assert "secret text" not in str(e.value)


@pytest.mark.parametrize("form", ["automaton", "broadcast", "shuffle"])
@pytest.mark.parametrize("ignore_case", [False, True])
def test_terms_equal_a_regex(spark, monkeypatch, ignore_case, form):
    if form == "shuffle":
        monkeypatch.setattr(terms_module, "BROADCAST_TERMS", 0)
    most = terms_module.AUTOMATON_BYTES if form == "automaton" else 0
    rng = random.Random(3)
    vocab = ["red", "Red", "ring", "big", "x9", "_a", "é", "bolt"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" ", "-", "  ", ". "]) for _ in range(30)) for _ in range(60)]
    terms = ["red ring", "red", "ring-big", "bolt", "big", "x9 _a x9", "ring"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    listed = spark.createDataFrame([(w, i) for i, w in enumerate(terms)], "term string, ord int")
    got = {r.id: [(s.start, s.end, s.value) for s in r.term_spans] for r in term_spans(df, ("id",), listed, "t", ignore_case=ignore_case, automaton_bytes=most).collect()}
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b", re.ASCII | (re.I if ignore_case else 0))
    for i, text in enumerate(texts):
        assert got.get(i, []) == [(*m.span(), m[0]) for m in pattern.finditer(text)], text


def test_automaton_details(spark):
    df = spark.createDataFrame([(1, "aa a aaa İred RED"), (1, None), (2, "aa"), (3, "none")], "id int, text string")
    listed = spark.createDataFrame([("aa a",), ("a",), ("aa",), ("red",), (None,)], "term string")
    got = term_spans(df, ("id",), listed, "t", ignore_case=True)
    assert {r.id: [(s.start, s.value, s.label, s.type) for s in r.term_spans] for r in got.collect()} == {
        1: [(0, "aa a", "t", "CUSTOM"), (10, "red", "t", "CUSTOM"), (14, "RED", "t", "CUSTOM")], 2: [(0, "aa", "t", "CUSTOM")],
    }
    assert term_spans(df, ("id",), listed.limit(0), "t").count() == 0
    assert term_spans(df.limit(0), ("id",), listed, "t").count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_policies_of_many_and_hot_tenants(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "MIN_HOT", 10)
    monkeypatch.setattr(lookup, "HOT_KEYS", 3)
    policies = spark.createDataFrame([(f"t{k}", "mask", {"EMAIL": "allow"}) for k in range(30)],
                                     "scope_key string, default_action string, overrides map<string,string>")
    rows = [(i, "t1" if i % 3 else f"t{i % 40}" if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, tenant string")
    got = {r.id: r.key_policy and r.key_policy.default for r in with_key_policy(df, policies, "tenant", max_rows=most).collect()}
    assert got == {i: "mask" if t and int(t[1:]) < 30 else None for i, t in rows}


def test_rules_from_files(spark, tmp_path):
    rules = [{"name": "a", "pattern": "x{2}"}, {"name": "b", "terms": ["red"], "flags": "i"}]
    (tmp_path / "array.json").write_text(json.dumps(rules, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rules)) + "\n")
    for name in ("array.json", "lines.json"):
        assert [r.name for r in load_rules(spark, str(tmp_path / name))] == ["a", "b"]
    with pytest.raises(ValueError, match="too large"):
        load_rules(spark, str(tmp_path / "array.json"), max_bytes=10)
    (tmp_path / "broken.json").write_text('[{"name": ""}]')
    with pytest.raises(ValueError):
        compile_rules(spark, load_rules(spark, str(tmp_path / "broken.json")))


def test_assigned_secrets(spark):
    texts = ['token = "7c72db563d7f6e50cec00950f7bab1f2"', "API_KEY: 'abcdefghij0123456789'", "secret=short", "my_token = abcdefghij0123456789",
             "password=abcdefghij0123456789-_x y", "sk-abcdefghijklmnopqrstuvwx"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [s.value for s in r.spans] for r in detect(df, detectors=(API_KEY_ASSIGNED,)).collect()}
    assert got == {0: ["7c72db563d7f6e50cec00950f7bab1f2"], 1: ["abcdefghij0123456789"], 2: [], 3: [],
                   4: ["abcdefghij0123456789-_x"], 5: ["sk-abcdefghijklmnopqrstuvwx"]}


def test_callers_and_recorded_replies(spark, tmp_path):
    df = spark.createDataFrame([("k", "1.1.1.1"), (None, "2.2.2.2"), (None, None)], "api_key string, client_ip string")
    assert [r[0] for r in df.select(caller_of()).collect()] == ["k", "2.2.2.2", None]
    (tmp_path / "reply.txt").write_text('data: {"choices":[{"delta":{"content":"[A_1] é"}}]}\n\ndata: [DONE]')
    lines = read_chunk_files(spark, str(tmp_path / "reply.txt"))
    assert [(r.seq, r.line[:6]) for r in lines.orderBy("seq").collect()] == [(0, "data: "), (1, ""), (2, "data: ")]


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "abc", "z"), (2, "a" * 20, "z"), (3, None, "z")], "id int, body string, other string")
    df.write.json(path)
    texts = read_texts(spark, path, "id", text="body", format="json")
    assert texts.columns == ["id", "text"]
    ok, refused = split_overlong(texts, limit=10)
    assert [r.id for r in ok.collect()] == [1]
    assert {r.id: r.error for r in refused.collect()} == {2: "text_too_long", 3: "missing_text"}
    assert "text" not in refused.columns
    sink = str(tmp_path / "deep" / "audit")
    events = spark.createDataFrame([("t", "1", "/r", False)], "ts string, request_id string, route string, blocked boolean")
    write_audit(events, "file", sink)
    write_audit(events, "file", sink)
    write_audit(events, "none")
    assert spark.read.json(sink).count() == 2
    with pytest.raises(ValueError):
        write_audit(events, "queue")
