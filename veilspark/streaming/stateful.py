"""Stateful streaming operators: event lines, chunks, byte lines and admission."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.functions.kinds import LIMITER_MAX_KEYS, MAX_STREAM_HOLD
from veilspark.operators.admission import decisions_of_free, full_after_ms, refill_rate, unlimited_route, with_retry_after
from veilspark.sources.chunks import payload_lines

_TOKEN = re.compile(r"\[[A-Z0-9_]+\]")
_OPEN = re.compile(r"\[[A-Z0-9_]*\Z")
#: Found in every payload that has a placeholder, or the start of one at its end, in one of its texts.
_MAYBE = re.compile(r'\[[A-Z0-9_"\\]|\\u005[bB]')

EMITTED = "stream_id string, seq long, choice int, tool_idx int, text string, flushed boolean"
DECIDED = "caller string, request_id long, ts_ms long, route string, allowed boolean, retry_after_ms long, remaining int"


class _Tails:
    """Held ends of a stream's sequences, by sequence name: ``choice`` or ``choice:tool``."""

    def __init__(self, held: dict[str, str], max_hold: int):
        self.held = held
        self.max_hold = max_hold
        self.parsed: dict[str, dict[str, str]] = {}

    def push(self, choice: int, tool: int | None, text: str, finished: bool) -> str:
        """What of a sequence can be shown now that ``text`` has come."""
        name = f"{choice}" if tool is None else f"{choice}:{tool}"
        text = self.held.pop(name, "") + text
        tail = None if finished else _OPEN.search(text)
        if tail and len(text) - tail.start() <= self.max_hold:
            self.held[name] = text[tail.start() :]
            text = text[: tail.start()]
        return text

    def flush(self) -> list[tuple[int, int | None, str]]:
        """(choice, tool, tail) of all that is held, content first; nothing is held afterwards."""
        found = []
        for name, tail in self.held.items():
            choice, _, tool = name.partition(":")
            found.append((int(choice), int(tool) if tool else None, tail))
        self.held.clear()
        return sorted(found, key=lambda f: (f[1] is not None, f[0], f[1] or 0))

    def restore(self, text: str, token_map: str | None) -> str:
        """Placeholders replaced. A map is read once, and only for a text that may hold one."""
        if "[" not in text or not isinstance(token_map, str):
            return text
        if token_map not in self.parsed:
            self.parsed = {token_map: json.loads(token_map)}
        tokens = self.parsed[token_map]
        return _TOKEN.sub(lambda m: tokens.get(m.group(), m.group()), text)


def _save(held: object, state: GroupState, timeout_ms: int | None) -> None:
    if held:
        state.update((json.dumps(held),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
    elif state.exists:
        state.remove()


def _chunk_function(max_hold: int, timeout_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (stream,) = key
        tails = _Tails(json.loads(state.get[0]) if state.exists else {}, max_hold)
        out: list[tuple] = []
        if state.hasTimedOut:
            out += [(stream, -1, *f, True) for f in tails.flush()]
            state.remove()
        else:
            for r in pd.concat(batches).sort_values("seq", kind="stable").itertuples(index=False):
                if r.done is True or r.done == 1:
                    out += [(stream, int(r.seq), *f, True) for f in tails.flush()]
                    continue
                choice = 0 if pd.isna(r.choice) else int(r.choice)
                tool = None if pd.isna(r.tool_idx) else int(r.tool_idx)
                fragment = r.fragment if isinstance(r.fragment, str) else ""
                text = tails.push(choice, tool, fragment, r.finished is True or r.finished == 1)
                out.append((stream, int(r.seq), choice, tool, tails.restore(text, r.token_map), False))
            _save(tails.held, state, timeout_ms)
        columns = ["stream_id", "seq", "choice", "tool_idx", "text", "flushed"]
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({"seq": "int64", "choice": "Int32", "tool_idx": "Int32", "flushed": "bool"})

    return run


_compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _written(value: dict) -> str:
    return "data: " + _compact(value)


def _frame(choice: int, tool: int | None, text: str) -> str:
    delta = {"content": text} if tool is None else {"tool_calls": [{"index": tool, "function": {"arguments": text}}]}
    return _written({"choices": [{"index": choice, "delta": delta}]})


def _is_index(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _restore_event(body: object, tails: _Tails, token_map: str | None) -> bool:
    """Put restored texts into a parsed payload; whether anything changed."""
    changed = False
    choices = body.get("choices") if isinstance(body, dict) else None
    for c in choices if isinstance(choices, list) else []:
        delta = c.get("delta") if isinstance(c, dict) else None
        if not isinstance(delta, dict):
            continue
        index = c["index"] if _is_index(c.get("index")) else 0
        finished = c.get("finish_reason") is not None
        content = delta.get("content")
        if isinstance(content, str) or finished:
            old = content if isinstance(content, str) else ""
            new = tails.restore(tails.push(index, None, old, finished), token_map)
            if new != old:
                delta["content"], changed = new, True
        calls = delta.get("tool_calls")
        for call in calls if isinstance(calls, list) else []:
            function = call.get("function") if isinstance(call, dict) else None
            old = function.get("arguments") if isinstance(function, dict) else None
            if isinstance(old, str):
                tool = call["index"] if _is_index(call.get("index")) else 0
                new = tails.restore(tails.push(index, tool, old, finished), token_map)
                if new != old:
                    function["arguments"], changed = new, True
    return changed


def _event_function(max_hold: int, timeout_ms: int | None):
    def lines_of(stream: str | None, tails: _Tails, rows: Iterator[tuple], out: list[tuple]) -> None:
        """The lines of one stream in order, restored."""
        for seq, payload, token_map in rows:
            line = f"data: {payload}"
            if payload == "[DONE]":
                flush(stream, seq, tails, out)
            elif tails.held or _MAYBE.search(payload):
                try:
                    body = json.loads(payload)
                except ValueError:
                    body = None
                if _restore_event(body, tails, token_map):
                    line = _written(body)
            out.append((stream, seq, 0, line))

    def flush(stream: str | None, seq: int, tails: _Tails, out: list[tuple]) -> None:
        found = tails.flush()
        out.extend((stream, seq, k - len(found), _frame(*f)) for k, f in enumerate(found))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str | None, dict[str, str]] = dict(json.loads(state.get[0])) if state.exists else {}
        out: list[tuple] = []
        if state.hasTimedOut:
            for stream, kept in held.items():
                flush(stream, -1, _Tails(kept, max_hold), out)
            state.remove()
        else:
            rows = pd.concat(batches)
            at, streams = pd.factorize(rows["stream_id"], use_na_sentinel=False)
            seq = rows["seq"].astype("int64").to_numpy()
            order = np.lexsort((seq, at))  # by stream and sequence number; equal ones stay as they came
            columns = (seq[order].tolist(), *(rows[c].to_numpy()[order].tolist() for c in ("payload", "token_map")))
            taken = zip(*columns)
            for stream, n in zip(streams, np.bincount(at).tolist()):
                stream = stream if isinstance(stream, str) else None
                tails = _Tails(held.pop(stream, {}), max_hold)
                lines_of(stream, tails, islice(taken, n), out)
                if tails.held:
                    held[stream] = tails.held
            _save(list(held.items()), state, timeout_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "part", "line"]).astype({"seq": "int64", "part": "int32"})

    return run


#: Groups of event streams, each with one state entry and one call into Python for a micro-batch.
EVENT_SHARDS = 1024


def rehydrate_event_stream(
    lines: DataFrame, maps: DataFrame, max_hold: int = MAX_STREAM_HOLD, enabled: bool = True, timeout_ms: int | None = None
) -> DataFrame:
    """Streaming twin of ``rehydrate_events``: ``stream_id, seq, part, line`` from ``stream_id, seq, line``.

    State per stream is its held tails, kept in ``EVENT_SHARDS`` shards by the hash of the stream, so the
    cost of a group is not paid for every stream. With ``timeout_ms`` it is kept per stream, as each has a
    timer of its own. A tail is released by a finish reason, by the end marker, or after ``timeout_ms``
    without lines; a stream that stops without any keeps it. Edited payloads keep the order of their keys.
    """
    data = payload_lines(lines.select("stream_id", "seq", "line")).select("stream_id", "seq", "payload")
    if not enabled:
        return data.select("stream_id", "seq", F.lit(0).alias("part"), F.concat(F.lit("data: "), "payload").alias("line"))
    known = data.join(maps.select("stream_id", F.to_json("token_map").alias("token_map")), "stream_id", "left")
    shard = F.col("stream_id") if timeout_ms else F.pmod(F.xxhash64("stream_id"), F.lit(EVENT_SHARDS)).cast("int")
    return known.withColumn("__shard", shard).groupBy("__shard").applyInPandasWithState(
        _event_function(max_hold, timeout_ms),
        "stream_id string, seq long, part int, line string",
        "held string",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout,
    )


def _lines_function(timeout_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (stream,) = key
        carry, number = state.get if state.exists else (b"", 0)
        carry, out = bytes(carry), []

        def add(raw: bytes) -> None:
            nonlocal number
            line = raw.decode("utf-8", "replace")
            out.append((stream, number, line.removeprefix("\ufeff") if number == 0 else line))
            number += 1

        if state.hasTimedOut:
            if carry:
                add(carry)
            state.remove()
        else:
            closed = False
            for r in pd.concat(batches).sort_values("seq", kind="stable").itertuples(index=False):
                *lines, carry = (carry + bytes(r.bytes or b"")).split(b"\n")
                for raw in lines:
                    add(raw)
                closed = closed or r.last is True or r.last == 1
            if closed:
                if carry:
                    add(carry)
                if state.exists:
                    state.remove()
            else:
                state.update((carry, number))
                if timeout_ms:
                    state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["stream_id", "line_no", "line"]).astype({"line_no": "int64"})

    return run


def line_stream(chunks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Streaming twin of ``lines_of_chunks``: ``stream_id, line_no, line`` from ``stream_id, seq, bytes, last``.

    State per body is the bytes behind its last line feed and its count of lines. A chunk marked
    ``last`` ends the body and releases what is left; without one it is released after ``timeout_ms``.
    """
    return chunks.select("stream_id", "seq", "bytes", "last").groupBy("stream_id").applyInPandasWithState(
        _lines_function(timeout_ms),
        "stream_id string, line_no long, line string",
        "carry binary, number long",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout,
    )


def rehydrate_chunk_stream(
    chunks: DataFrame,
    maps: DataFrame,
    max_hold: int = MAX_STREAM_HOLD,
    enabled: bool = True,
    timeout_ms: int | None = None,
) -> DataFrame:
    """Streaming twin of the batch operator. State per stream is its held tails, keyed by sequence.

    Rows are put in ``seq`` order inside a micro-batch; across micro-batches arrival order counts.
    With ``timeout_ms``, streams that stop without an end marker release their tails after that time;
    such a query keeps running batches to see timeouts, so it never ends by itself.
    """
    if not enabled:
        return chunks.where(~F.coalesce("done", F.lit(False))).select(
            "stream_id", "seq", "choice", "tool_idx", F.col("fragment").alias("text"), F.lit(False).alias("flushed")
        )
    known = chunks.join(maps.select("stream_id", F.to_json("token_map").alias("token_map")), "stream_id", "left")
    return (
        known.select("stream_id", "seq", "choice", "tool_idx", "fragment", "finished", "done", "token_map")
        .groupBy("stream_id")
        .applyInPandasWithState(
            _chunk_function(max_hold, timeout_ms),
            EMITTED,
            "held string",
            "append",
            GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout,
        )
    )


def _bucket_function(capacity: float, refill_per_ms: float, full_ms: int | None, expire: bool):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # The bucket has refilled; a full bucket is the same as none.
            state.remove()
            return
        rows = pd.concat(batches).sort_values(["ts_ms", "request_id"], kind="stable")
        tokens, last = state.get if state.exists else (float(capacity), int(rows["ts_ms"].iloc[0]))
        allowed, wait, left = [], [], []
        for ts in rows["ts_ms"].tolist():
            tokens, last, passed = _take(tokens, last, ts, capacity, refill_per_ms)
            allowed.append(passed)
            wait.append(0 if passed else math.ceil((1 - tokens) / refill_per_ms) if refill_per_ms > 0 else None)
            left.append(math.floor(tokens) if passed else 0)
        state.update((float(tokens), int(last)))
        if expire and full_ms is not None:
            state.setTimeoutTimestamp(max(last + full_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "caller": rows["caller"],
                "request_id": rows["request_id"],
                "ts_ms": rows["ts_ms"],
                "route": rows["route"],
                "allowed": allowed,
                "retry_after_ms": pd.array(wait, dtype="Int64"),
                "remaining": pd.array(left, dtype="Int32"),
            }
        )

    return run


def _take(tokens: float, last: int, ts: int, capacity: float, refill_per_ms: float) -> tuple[float, int, bool]:
    """One request: tokens and time afterwards, and whether it passed."""
    if ts > last:
        tokens, last = min(capacity, tokens + (ts - last) * refill_per_ms), ts
    return (tokens - 1, last, True) if tokens >= 1 else (tokens, last, False)


def _shard_function(capacity: float, refill_per_ms: float, full_ms: int | None, most: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buckets = {c: (t, at) for c, t, at in (json.loads(state.get[0]) if state.exists else [])}
        rows = pd.concat(batches).sort_values(["ts_ms", "request_id"], kind="stable")
        allowed, wait, left = [], [], []
        callers = [None if pd.isna(c) else c for c in rows["caller"].tolist()]
        for caller, ts in zip(callers, rows["ts_ms"].tolist()):
            tokens, last, passed = _take(*buckets.get(caller, (float(capacity), ts)), ts, capacity, refill_per_ms)
            buckets[caller] = (tokens, last)
            allowed.append(passed)
            wait.append(0 if passed else math.ceil((1 - tokens) / refill_per_ms) if refill_per_ms > 0 else None)
            left.append(math.floor(tokens) if passed else 0)
        if len(buckets) > most and full_ms is not None:
            # A full bucket is the same as none. The clock is the latest request of these callers.
            now = max(at for _, at in buckets.values())
            buckets = {c: (t, at) for c, (t, at) in buckets.items() if now - at < full_ms}
        state.update((json.dumps([[c, t, at] for c, (t, at) in buckets.items()]),))
        yield pd.DataFrame(
            {
                "caller": callers,
                "request_id": rows["request_id"].to_numpy(),
                "ts_ms": rows["ts_ms"].to_numpy(),
                "route": rows["route"].to_numpy(),
                "allowed": allowed,
                "retry_after_ms": pd.array(wait, dtype="Int64"),
                "remaining": pd.array(left, dtype="Int32"),
            }
        )

    return run


#: Callers that share one state entry, when there are as many as the limit allows.
CALLERS_A_SHARD = 32


def admit_stream(
    requests: DataFrame,
    capacity: float,
    refill_per_ms: float,
    watermark: str | None = None,
    max_keys: int = LIMITER_MAX_KEYS,
) -> DataFrame:
    """Streaming admission of requests ``caller, request_id, ts_ms, route[, ts]``.

    State is bounded by ``max_keys`` callers, two numbers each, kept in ``max_keys / 32`` shards by the
    hash of the caller. A shard with more than its share drops the buckets that have refilled, which
    are the same as none; only callers that are busy at one time can exceed the bound. No request is
    lost, however late: one older than its caller's last is decided against the tokens left, or by a
    full bucket if the caller's was dropped. ``max_keys`` must stay the same for one checkpoint.

    With ``watermark`` (a delay on the timestamp column ``ts``) state is kept per caller and dropped by
    timers instead; as with any watermark, requests later than the delay get no decision.
    """
    full_ms = full_after_ms(capacity, refill_per_ms)
    if watermark:
        run = _bucket_function(capacity, refill_per_ms, full_ms, True)
        return requests.withWatermark("ts", watermark).groupBy("caller").applyInPandasWithState(
            run, DECIDED, "tokens double, last_ms long", "append", GroupStateTimeout.EventTimeTimeout
        )
    shards = max(1, max_keys // CALLERS_A_SHARD)
    shard = F.pmod(F.xxhash64("caller"), F.lit(shards)).cast("int")
    run = _shard_function(capacity, refill_per_ms, full_ms, -(-max_keys // shards))
    return requests.withColumn("__shard", shard).groupBy("__shard").applyInPandasWithState(
        run, DECIDED, "buckets string", "append", GroupStateTimeout.NoTimeout
    )


def rate_limit_stream(
    requests: DataFrame,
    limit: int,
    window_sec: int = 60,
    watermark: str | None = None,
    max_keys: int = LIMITER_MAX_KEYS,
) -> DataFrame:
    """Streaming admission with the server's settings; adds ``retry_after_sec`` for denied requests.

    As in the batch form, a limit of zero or less turns it off and health and metrics routes are never
    limited and never reach the state.
    """
    columns = ["caller", "request_id", "ts_ms", "route"]
    if limit <= 0:
        return with_retry_after(requests.select(*columns).withColumns(decisions_of_free()))
    free = unlimited_route("route")
    counted = admit_stream(requests.where(~free), limit, refill_rate(limit, window_sec), watermark, max_keys)
    passed = requests.where(free).select(*columns).withColumns(decisions_of_free())
    return with_retry_after(counted.unionByName(passed))
