"""Event lines and byte chunks: batch against plain loops, streams against batch."""

import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.operators.events import rehydrate_events
from veilspark.operators.messages import rehydrate_replies
from veilspark.sources import bytes as byte_lines
from veilspark.sources.bytes import lines_of_chunks
from veilspark.sources.chunks import payload_lines
from veilspark.sources.text import read_lines
from veilspark.streaming import stateful
from veilspark.streaming.stateful import line_stream, rehydrate_event_stream
from veilspark.streaming.stateless import drain

LINES = "stream_id string, seq long, line string"
MAP = {"[NAME_1]": "Ada \"B\" é", "[EMAIL_1]": "a@b.com", "[EMAIL_11]": "z@b.com"}


def maps_of(spark, streams):
    return spark.createDataFrame([(s, MAP) for s in streams], "stream_id string, token_map map<string,string>")


def in_steps(spark, df, folder, parts):
    """The rows as a stream of several micro-batches, in order of ``seq``."""
    rows = df.orderBy("seq").collect()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")


def test_lines_of_a_reply_all_come_back(spark):
    sent = [
        'data: {"id":"c1","model":"m","choices":[{"index":0,"delta":{"role":"assistant"},"finish_reason":null}]}',
        'data: {"id":"c1","model":"m","choices":[{"index":0,"delta":{"content":"to [EMA"},"finish_reason":null}]}',
        'data: {"id":"c1","model":"m","choices":[{"index":0,"delta":{"content":"IL_1] [X"},"finish_reason":null}]}',
        'data: {"id":"c1","choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}',
        'data: {"id":"c1","choices":[],"usage":{"total_tokens":9}}',
        "data: {broken",
        "data: [DONE]",
    ]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(sent)], LINES)
    got = [r.line for r in rehydrate_events(df, maps_of(spark, ["s"])).orderBy("seq", "part").collect()]
    assert len(got) == 7 and [got[i] for i in (0, 4, 5, 6)] == [sent[i] for i in (0, 4, 5, 6)]
    bodies = [json.loads(x[6:]) for x in got[1:4]]
    assert [b["choices"][0]["delta"]["content"] for b in bodies] == ["to ", "a@b.com ", "[X"]
    assert [b["id"] for b in bodies] == ["c1"] * 3 and bodies[0]["model"] == "m"
    assert bodies[2]["choices"][0]["finish_reason"] == "stop"
    off = rehydrate_events(df, maps_of(spark, ["s"]), enabled=False).orderBy("seq").collect()
    assert [r.line for r in off] == sent


def some_lines(seed):
    """Streams with several choices and calls, ends of every kind, and texts cut anywhere."""
    draw = random.Random(seed)
    rows = []
    text = "Hi [NAME_1], [EMAIL_1][EMAIL_11] [note] [NOPE_2] " + "[" + "A" * 70 + " end [EMAIL_1"
    for s in range(8):
        stream, seq = f"s{s}", 0
        left = {(c, t): draw.choice([text, text[::-1], text * 2]) for c in (0, 1) for t in (None, 0, 3)}
        while any(left.values()):
            body = {"id": stream, "n": 1.5, "choices": []}
            for c in draw.sample([0, 1], draw.randint(1, 2)):
                delta, n = {}, draw.randint(0, 9)
                if draw.random() < 0.7:
                    delta["content"], left[c, None] = left[c, None][:n], left[c, None][n:]
                calls = []
                for t in draw.sample([0, 3], draw.randint(0, 2)):
                    n = draw.randint(0, 9)
                    calls.append({"index": t, "id": "x", "function": {"name": "f", "arguments": left[c, t][:n]}})
                    left[c, t] = left[c, t][n:]
                if calls:
                    delta["tool_calls"] = calls
                entry = {"index": c, "delta": delta}
                if draw.random() < 0.05:
                    entry["finish_reason"] = "length"
                body["choices"].append(entry)
            rows.append((stream, seq, draw.choice(["data: ", "data:", "  data:  "]) + json.dumps(body)))
            seq += 1
            if draw.random() < 0.2:
                rows.append((stream, seq, draw.choice(["", ": note", "event: x", 'data: {"choices":3}', "data: 7", "data: {oops"])))
                seq += 1
        if s % 3:
            rows.append((stream, seq, "data: [DONE]"))
    return rows


def plain_events(rows, tokens, flush_at_end=True):
    """(stream, seq, part) -> parsed payload or payload text."""
    out, held, last = {}, {}, {}

    def swap(text):
        return re.sub(r"\[[A-Z0-9_]+\]", lambda m: tokens.get(m.group(), m.group()), text)

    def push(stream, c, t, text, finished):
        text = held.pop((stream, c, t), "") + text
        tail = re.search(r"\[[A-Z0-9_]*\Z", text)
        if tail and not finished and len(tail.group()) <= 64:
            held[stream, c, t], text = tail.group(), text[: tail.start()]
        return swap(text)

    def frames(stream, seq, first):
        found = sorted((k for k in held if k[0] == stream), key=lambda k: (k[2] is not None, k[1], k[2] or 0))
        for n, k in enumerate(found):
            tail = held.pop(k)
            delta = {"content": tail} if k[2] is None else {"tool_calls": [{"index": k[2], "function": {"arguments": tail}}]}
            out[stream, seq, n - len(found) if first else n + 1] = {"choices": [{"index": k[1], "delta": delta}]}

    for stream, seq, line in rows:
        line = line.strip()
        if not line.startswith("data:"):
            continue
        payload = line[5:].strip()
        if payload == "[DONE]":
            frames(stream, seq, True)
            out[stream, seq, 0] = payload
            last.pop(stream, None)
            continue
        try:
            body = json.loads(payload)
        except ValueError:
            out[stream, seq, 0] = payload
            continue
        if isinstance(body, dict) and isinstance(body.get("choices"), list):
            for c in body["choices"]:
                finished, delta = c.get("finish_reason") is not None, c["delta"]
                if "content" in delta or finished:
                    new = push(stream, c["index"], None, delta.get("content", ""), finished)
                    if new or "content" in delta:
                        delta["content"] = new
                    last[stream, c["index"], None] = seq
                for call in delta.get("tool_calls", []):
                    call["function"]["arguments"] = push(stream, c["index"], call["index"], call["function"]["arguments"], finished)
                    last[stream, c["index"], call["index"]] = seq
        out[stream, seq, 0] = body
    return out, held


def parsed(rows):
    def body(line):
        try:
            return json.loads(line[6:])
        except ValueError:
            return line[6:]

    return {(r.stream_id, r.seq, r.part): body(r.line) for r in rows}


@pytest.mark.parametrize("source", ["maps", "tokens"])
def test_events_equal_a_plain_loop(spark, source):
    rows = some_lines(4)
    streams = sorted({r[0] for r in rows})
    given = {"maps": maps_of(spark, streams)}
    if source == "tokens":
        given = {"tokens": given["maps"].select("stream_id", F.explode("token_map").alias("placeholder", "value"))}
    df = spark.createDataFrame(rows, LINES).repartition(5)
    want, _ = plain_events(rows, MAP)
    got = parsed(rehydrate_events(df, flush_at_end=False, **given).collect())
    assert got == want
    # With the flush, what is left of a stream without an end comes behind its last texts.
    more = parsed(rehydrate_events(df, **given).collect())
    assert {k: v for k, v in more.items() if k in want} == want
    assert all(part > 0 and stream in ("s0", "s3", "s6") for stream, _, part in more.keys() - want.keys())


def test_event_stream_equals_batch(spark, tmp_path):
    rows = some_lines(9)
    df = spark.createDataFrame(rows, LINES)
    maps = maps_of(spark, sorted({r[0] for r in rows}))
    want, held = plain_events(rows, MAP)
    assert held  # some streams stop without an end
    got = parsed(drain(rehydrate_event_stream(in_steps(spark, df, str(tmp_path), 4), maps), "events").collect())
    assert got == want


class State:
    """What a group function sees of its state, without a session."""

    hasTimedOut = False

    def __init__(self):
        self.get = None

    @property
    def exists(self):
        return self.get is not None

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None


def in_group(rows, state, run):
    frame = pd.DataFrame([(*r, json.dumps(MAP)) for r in rows], columns=["stream_id", "seq", "payload", "token_map"])
    return parsed(pd.concat(run((0,), iter([frame[:7], frame[7:]]), state)).itertuples(index=False))


def test_a_group_of_many_event_streams_equals_one_at_a_time():
    rows = [r for r in some_lines(5) if r[2].strip().startswith("data:")]
    random.Random(1).shuffle(rows)
    rows = sorted(rows, key=lambda r: r[1] // 4)  # out of order, but in two halves that are not
    half = next(k for k, r in enumerate(rows) if r[1] >= 8)
    want, held = plain_events(sorted(rows, key=lambda r: r[1]), MAP)
    assert len({k[0] for k in held}) > 1
    rows = [(None if s == "s1" else s, q, line.strip()[5:].strip()) for s, q, line in rows]
    run, state = stateful._event_function(64, None), State()
    got = in_group(rows[:half], state, run) | in_group(rows[half:], state, run)
    assert got == {(None if s == "s1" else s, q, k): v for (s, q, k), v in want.items()}
    # Only streams that hold something are kept, and a timer releases what they hold.
    assert {s for s, _ in json.loads(state.get[0])} == {k[0] for k in held}
    state.hasTimedOut = True
    assert len(in_group([], state, run)) == len(held) and not state.exists


def test_only_payloads_that_can_change_are_parsed(monkeypatch):
    draw, rows = random.Random(8), []
    bits = ["[", "]", "A", "EMAIL_1", "NAME_1]", "\\u005b", "\\u005B", "\\u0041", "\\n", "\\[", "é", " ", "x", "[ {", "[]", "1", '\\"', "\\\\"]
    shapes = ['{"choices":[{"index":0,"delta":{"content":"%s"}}]}', '{"choices": [ {"delta":{"content":"%s"},"finish_reason":"stop"}]}',
              '{"choices":[{"delta":{"tool_calls":[{"function":{"arguments":"%s"}}]}}]}', '{"a":["%s"],"choices":[]}', "%s", "[DONE]"]
    for stream in "abcdefgh":
        for seq in range(80):
            shape = draw.choice(shapes[:4] * 6 + shapes)
            rows.append((stream, seq, shape.replace("%s", "".join(draw.choices(bits, k=draw.randint(0, 5))))))
    run = stateful._event_function(64, None)

    def lines(rows):
        frame = pd.DataFrame([(*r, json.dumps(MAP)) for r in rows], columns=["stream_id", "seq", "payload", "token_map"])
        return [tuple(r) for r in pd.concat(run((0,), iter([frame]), State())).itertuples(index=False)]

    got = lines(rows)
    monkeypatch.setattr(stateful, "_MAYBE", re.compile(""))
    assert got == lines(rows) and any("Ada" in r[3] for r in got)
    monkeypatch.undo()
    monkeypatch.setattr(stateful.json, "loads", lambda x: pytest.fail(x))
    plain = [("a", k, shapes[0].replace("%s", "no bracket")) for k in range(9)]
    assert lines(plain) == [("a", k, 0, f"data: {x}") for _, k, x in plain]


def test_event_stream_has_no_group_for_every_stream_and_parses_nothing_twice(spark, tmp_path):
    rows = [(f"s{k}", q, line) for k in range(30) for q, line in enumerate(['data: {"choices":[{"delta":{"content":"[EMA"}}]}', "x", "data: [DONE]"])]
    lines = in_steps(spark, spark.createDataFrame(rows, LINES), str(tmp_path), 1)
    plan = rehydrate_event_stream(lines, maps_of(spark, ["s1"]))._jdf.queryExecution().analyzed().toString()
    assert "parse_json" not in plan and "__shard" in plan
    timed = rehydrate_event_stream(lines, maps_of(spark, ["s1"]), timeout_ms=5)._jdf.queryExecution().analyzed().toString()
    assert "xxhash64" in plan and "xxhash64" not in timed  # a timer belongs to one stream


def test_blanks_around_lines_and_payloads(spark):
    ends = ["", " ", "\t\r\n", "\x0b\f", "\u2028", " \u2028", "\x85", " \x85\n", "\u00a0", " \u3000", "\n\u2029"]
    lines = [(f"{a}data:{b}x {c}y{d}",) for a in ends for b in ends for c in ("", "\u2028") for d in ends]
    lines += [(x,) for x in ("data:", "data: ", " data: \n", "date: x", "", " ", None)]
    df = spark.createDataFrame(lines, "line string")
    trimmed = df.withColumn("t", F.regexp_replace("line", r"^\s+|\s+$", "")).where(F.col("t").startswith("data:"))
    want = trimmed.select(F.regexp_replace(F.substring("t", 6, 2_000_000_000), r"^\s+", ""))
    assert sorted(r[0] for r in payload_lines(df).collect()) == sorted(r[0] for r in want.collect())


def test_event_stream_of_many_files_equals_the_batch_query(spark, tmp_path):
    from veilspark.plans import catalog

    rows = [(c, t, "user", f"to [EMAIL_1] é {c}" * t) for c in range(20) for t in range(3)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    talks.repartition(20).write.parquet(f"{tmp_path}/conversations.parquet")  # micro-batches of 16 files
    got, want = (q(spark, str(tmp_path)).collect() for q in (catalog.event_stream, catalog.event_write_back))
    assert len(got) > 900 and sorted(map(str, got)) == sorted(map(str, want))


def test_replies_without_an_id_go_on_in_the_order_of_their_file(spark, tmp_path):
    from veilspark.plans import catalog, tables

    talks = spark.createDataFrame([(None, k, "user", "ab" * k) for k in range(12)], "conv_id long, turn long, role string, text string")
    talks.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    replies = spark.read.parquet(f"{tmp_path}/conversations.parquet").selectExpr("turn", "CAST(NULL AS STRING) AS stream_id", f"{tables.reply_text()} AS text")
    sent = [(None, r.seq, r.payload, None) for r in payload_lines(tables.reply_lines(replies)).collect()]
    frame = pd.DataFrame(sent, columns=["stream_id", "seq", "payload", "token_map"])
    want = [tuple(r) for r in pd.concat(stateful._event_function(64, None)((0,), iter([frame]), State())).itertuples(index=False)]
    want = catalog._event_shown(spark.createDataFrame(want, "stream_id string, seq long, part int, line string"))
    assert sorted(map(str, catalog.event_stream(spark, str(tmp_path)).collect())) == sorted(map(str, want.collect()))


def test_streams_without_an_id_or_lines(spark):
    df = spark.createDataFrame([(None, 0, 'data: {"choices":[{"delta":{"content":"[EMAIL_1] [E"}}]}')], LINES)
    got = [r.line for r in rehydrate_events(df, maps_of(spark, [None])).orderBy("part").collect()]
    assert [json.loads(x[6:])["choices"][0]["delta"]["content"] for x in got] == ["a@b.com ", "[E"]
    assert rehydrate_events(df.limit(0), maps_of(spark, ["s"])).count() == 0


def test_replies_from_token_rows(spark):
    body = {"choices": [{"message": {"content": "to [EMAIL_1], [NOPE_1]", "tool_calls": [{"function": {"arguments": '{"a":"[NAME_1]"}'}}]}}]}
    rows = [(None, json.dumps(body)), (1, json.dumps(body).replace("[EMAIL", "\\u005bEMAIL")), (1, "no json [EMAIL_1]"), (2, None)]
    tokens = spark.createDataFrame([(s, k, v) for s in (None, 1) for k, v in (("[EMAIL_1]", "a@b.com"), ("[NAME_1]", "Ada"))],
                                   "scope int, placeholder string, value string")
    got = rehydrate_replies(spark.createDataFrame(rows, "scope int, reply string"), tokens, ["scope"]).collect()
    done = {(r.scope, r.reply): r.restored for r in got}
    for key in rows[:2]:
        message = json.loads(done[key])["choices"][0]["message"]
        assert message["content"] == "to a@b.com, [NOPE_1]"
        assert message["tool_calls"][0]["function"]["arguments"] == '{"a":"Ada"}'
    assert done[rows[2]] == rows[2][1] and done[rows[3]] is None


def bodies():
    return {
        "a": "﻿data: é\n\nzwei ✓\r\nlast 𝄞 line".encode(),
        "b": b"\n\n\n",
        "c": ("x" * 500 + "\n").encode() * 3 + b"bad \xff\xc3 end\n",
        "d": b"",
        "e": "ü".encode() * 400,
    }


def plain_lines():
    out = []
    for name, raw in bodies().items():
        parts = raw.split(b"\n")
        lines = parts[:-1] + ([parts[-1]] if parts[-1] else [])
        out += [(name, i, x.decode("utf-8", "replace").removeprefix("﻿" if i == 0 else "\0")) for i, x in enumerate(lines)]
    return out


def chunk_rows(size, seed=0):
    draw, rows = random.Random(seed), []
    for name, raw in bodies().items():
        at, seq = 0, 0
        while at < len(raw):
            n = draw.randint(1, size)
            rows.append((name, seq, raw[at : at + n], at + n >= len(raw)))
            at, seq = at + n, seq + draw.randint(1, 3)
    return [*rows, ("f", 0, b"", True), ("f", 1, None, False)]


CHUNKS = "stream_id string, seq long, bytes binary, last boolean"


@pytest.mark.parametrize("size,bits", [(1, 3), (2, 12), (7, 1), (400, 0), (5000, 12)])
def test_no_cut_changes_a_line(spark, monkeypatch, size, bits):
    monkeypatch.setattr(byte_lines, "RANGE_BITS", bits)
    df = spark.createDataFrame(chunk_rows(size), CHUNKS).repartition(3)
    got = sorted((r.stream_id, r.line_no, r.line) for r in lines_of_chunks(df).collect())
    assert got == sorted(plain_lines())


def test_null_ids_and_no_chunks(spark):
    df = spark.createDataFrame([(None, 0, b"a\nb", False), (None, 1, b"c\n", True)], CHUNKS)
    assert sorted(tuple(r) for r in lines_of_chunks(df).collect()) == [(None, 0, "a"), (None, 1, "bc")]
    assert lines_of_chunks(df.limit(0)).count() == 0


def test_line_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(chunk_rows(9, seed=3), CHUNKS)
    got = drain(line_stream(in_steps(spark, df, str(tmp_path), 4)), "lines")
    assert sorted((r.stream_id, r.line_no, r.line) for r in got.collect()) == sorted(plain_lines())


def test_lines_of_files_read_in_blocks(spark, tmp_path):
    draw = random.Random(2)
    want = {}
    for name in ("a", "b"):
        lines = ["".join(draw.choices("xyzé \r", k=draw.randint(0, 30))) for _ in range(700)]
        (tmp_path / f"{name}.txt").write_bytes("\n".join(lines).encode() + (b"\n" if name == "a" else b""))
        want[name] = lines[:-1] if name == "b" and not lines[-1] else lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 900)  # a block holds some fifty lines
        rows = read_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.line_no)):
        got.setdefault(r.path.split("/")[-1][0], []).append((r.line_no, r.text))
    assert got == {k: list(enumerate(v)) for k, v in want.items()}
