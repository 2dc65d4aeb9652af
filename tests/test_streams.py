"""Admission and chunk rehydration: batch and streaming against plain loops."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import chunks as chunk_ops
from veilspark.operators.admission import admit, rate_limit
from veilspark.operators.chunks import rehydrate_chunks
from veilspark.sources.chunks import parse_chunk_lines
from veilspark.streaming.stateful import admit_stream, rehydrate_chunk_stream
from veilspark.streaming.stateless import drain

REQ = "caller string, request_id long, ts_ms long, route string"


def bucket_loop(rows, capacity, rate):
    state, out = {}, {}
    for caller, rid, ts, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        tokens, last = state.get(caller, (float(capacity), ts))
        if ts > last:
            tokens, last = min(capacity, tokens + (ts - last) * rate), ts
        if tokens >= 1:
            tokens -= 1
            out[rid] = (True, 0, math.floor(tokens))
        else:
            out[rid] = (False, math.ceil((1 - tokens) / rate) if rate else None, 0)
        state[caller] = (tokens, last)
    return out


def random_requests(seed, n=600):
    """Busy callers, idle gaps, bursts within a millisecond, and one caller with a third of all."""
    rng = random.Random(seed)
    rows, clock = [], 10_000
    for i in range(n):
        clock += rng.choice([0, 0, 1, 40, 300, 9_000])
        caller = "hot" if rng.random() < 0.33 else rng.choice("abc")
        rows.append((caller, i, clock, rng.choice(["/v1/redact", "/health", "/health?x=1"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("capacity,rate", [(2, 1 / 1000), (3, 3 / 7000), (1, 1 / 64), (3, 0.0)])
def test_admission(spark, capacity, rate):
    rows = random_requests(capacity)
    df = spark.createDataFrame(rows, REQ)
    got = {r.request_id: (r.allowed, r.retry_after_ms, r.remaining) for r in admit(df, capacity, rate).collect()}
    assert got == bucket_loop(rows, capacity, rate)


def test_admission_small_case(spark):
    rows = [("k", i, t, "/") for i, t in enumerate([0, 0, 0, 1000, 1000])]
    got = [(r.allowed, r.retry_after_ms) for r in admit(spark.createDataFrame(rows, REQ), 2, 1 / 1000).orderBy("request_id").collect()]
    assert got == [(True, 0), (True, 0), (False, 1000), (True, 0), (False, 1000)]


def test_rate_limit_settings(spark):
    rows = random_requests(9)
    df = spark.createDataFrame(rows, REQ)
    assert rate_limit(df, 0).where("NOT allowed").count() == 0
    got = {r.request_id: (r.allowed, r.retry_after_sec) for r in rate_limit(df, 2, 5).collect()}
    want = bucket_loop([r for r in rows if not r[3].startswith("/health")], 2, 2 / 5000)
    assert len(got) == len(rows)
    for _, rid, _, route in rows:
        if route.startswith("/health"):
            assert got[rid] == (True, None)
        else:
            ok, wait, _ = want[rid]
            assert got[rid] == (ok, None if ok else max(1, math.ceil(wait / 1000)))


def test_admission_stream_over_several_batches(spark, tmp_path):
    rows = sorted(random_requests(4), key=lambda r: (r[2], r[1]))
    source = str(tmp_path / "in")
    for i in range(0, len(rows), 150):
        # Files are taken in order of their time stamps.
        part = spark.createDataFrame(rows[i : i + 150], REQ).withColumn("ts", F.timestamp_millis("ts_ms"))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(f"{REQ}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    done = drain(admit_stream(stream, 2, 1 / 1000), "a")
    got = {r.request_id: (r.allowed, r.retry_after_ms, r.remaining) for r in done.collect()}
    assert got == bucket_loop(rows, 2, 1 / 1000)
    purged = drain(admit_stream(stream, 2, 1 / 1000, watermark="1 hour"), "b")
    assert {r.request_id: (r.allowed, r.retry_after_ms, r.remaining) for r in purged.collect()} == got


MAP = {"[EMAIL_1]": "jane@acme.com", "[PHONE_1]": "415-555-0132"}
CHUNK = "stream_id string, seq long, choice int, tool_idx int, fragment string, finished boolean, done boolean"


def chunk_loop(rows, max_hold=64):
    """Emitted text per (stream, seq, key), and the flushed tails."""
    restore = lambda s: re.sub(r"\[[A-Z0-9_]+\]", lambda m: MAP.get(m[0], m[0]), s)
    held, out, last = {}, {}, {}
    for sid, seq, choice, tool, fragment, finished, done in sorted(rows, key=lambda r: (r[0], r[1])):
        if done:
            for key in [k for k in held if k[0] == sid and held[k]]:
                out[(sid, seq, key[1], key[2], True)] = held.pop(key)
            continue
        key = (sid, choice, tool)
        text = held.pop(key, "") + (fragment or "")
        m = re.search(r"\[[A-Z0-9_]*\Z", text)
        if m and not finished and len(text) - m.start() <= max_hold:
            held[key], text = text[m.start() :], text[: m.start()]
        out[(sid, seq, choice, tool, False)] = restore(text)
        last[key] = seq
    for key, tail in held.items():
        if tail:
            out[(key[0], last[key], key[1], key[2], True)] = tail
    return out


def random_chunks(seed, streams=12):
    rng = random.Random(seed)
    bits = ["ping ", "[", "EMAIL", "_1", "]", "[EMAIL_1]", "[PHONE_1", "]", "", "[SSN_9]", "[note 1]", "A" * 30, "x", "\n", "é"]
    rows = []
    for s in range(streams):
        n = rng.randrange(1, 150)
        for seq in range(n):
            choice = rng.choice([0, 0, 1])
            tool = rng.choice([None, None, 2])
            fragment = rng.choice(bits) if rng.random() < 0.97 else None
            rows.append((f"s{s}", seq, choice, tool, fragment, rng.random() < 0.03, False))
        if s % 2:
            rows.append((f"s{s}", n, None, None, None, None, True))
    return rows


def shown(df):
    return {(r.stream_id, r.seq, r.choice, r.tool_idx, r.flushed): r.text for r in df.collect()}


@pytest.mark.parametrize("bits", [12, 3])
def test_chunks(spark, bits, monkeypatch):
    """Also with tiny ranges, so that tails are carried over many range borders."""
    monkeypatch.setattr(chunk_ops, "RANGE_BITS", bits)
    rows = random_chunks(bits)
    maps = spark.createDataFrame([(f"s{i}", MAP) for i in range(12)], "stream_id string, token_map map<string,string>")
    assert shown(rehydrate_chunks(spark.createDataFrame(rows, CHUNK), maps)) == chunk_loop(rows)


@pytest.mark.parametrize(
    "parts,expected",
    [
        (["I emailed [EMAIL_1] today"], ["I emailed jane@acme.com today"]),
        (["ping [", "EMAIL", "_1] now"], ["ping ", "", "jane@acme.com now"]),
        (["call [PHO", "NE_1]!"], ["call ", "415-555-0132!"]),
        (["[" + "A" * 200 + " end"], ["[" + "A" * 200 + " end"]),
        (["[" + "A" * 200, "_1]"], ["[" + "A" * 200, "_1]"]),
    ],
)
def test_chunk_cases(spark, parts, expected):
    rows = [("s", i, 0, None, t, False, False) for i, t in enumerate(parts)]
    maps = spark.createDataFrame([("s", MAP)], "stream_id string, token_map map<string,string>")
    out = rehydrate_chunks(spark.createDataFrame(rows, CHUNK), maps).where("NOT flushed").orderBy("seq").collect()
    assert [r.text for r in out] == expected


def test_chunks_off(spark):
    rows = [("s", 0, 0, None, "[EMAIL_1]", False, False), ("s", 1, None, None, None, None, True)]
    maps = spark.createDataFrame([("s", MAP)], "stream_id string, token_map map<string,string>")
    out = rehydrate_chunks(spark.createDataFrame(rows, CHUNK), maps, enabled=False).collect()
    assert [(r.seq, r.text) for r in out] == [(0, "[EMAIL_1]")]


def test_chunk_stream_equals_batch(spark, tmp_path):
    rows = [r for r in random_chunks(5) if int(r[0][1:]) % 2]
    source = str(tmp_path / "in")
    rows.sort(key=lambda r: r[1])
    for i in range(0, len(rows), 200):
        spark.createDataFrame(rows[i : i + 200], CHUNK).coalesce(1).write.mode("append").parquet(source)
    maps = spark.createDataFrame([(f"s{i}", MAP) for i in range(12)], "stream_id string, token_map map<string,string>")
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(source)
    assert shown(drain(rehydrate_chunk_stream(stream, maps), "c")) == chunk_loop(rows)


def test_chunk_lines(spark):
    lines = [
        'data: {"choices":[{"index":0,"delta":{"content":"I [EMA"}}]}',
        "",
        ": comment",
        '  data:{"choices":[{"delta":{"tool_calls":[{"index":1,"function":{"arguments":"{\\"to\\""}},{"function":{}}]}}]}',
        'data: {"choices":[{"index":3,"delta":{},"finish_reason":"stop"}]}',
        'data: {"choices":[{"index":3,"finish_reason":"stop"}]}',
        "data: {broken",
        'data: {"usage":1}',
        "data: [DONE]",
    ]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream_id string, seq long, line string")
    got = {r.seq: (r.choice, r.tool_idx, r.fragment, r.finished, r.done, r.passthrough) for r in parse_chunk_lines(df).collect()}
    assert got[0] == (0, None, "I [EMA", False, False, None)
    assert got[3] == (0, 1, '{"to"', False, False, None)
    assert got[4] == (3, None, None, True, False, None)
    assert got[5][5] == json.dumps({"choices": [{"index": 3, "finish_reason": "stop"}]}, separators=(",", ":"))
    assert got[6][5] == "{broken" and got[7][5] == '{"usage":1}'
    assert got[8] == (None, None, None, None, True, None)
    assert sorted(got) == [0, 3, 4, 5, 6, 7, 8]
