"""Conversation-scope redaction as a stream: one numbering over all micro-batches of a conversation.

Detection, policy and substitution are the batch operator's column expressions. Only the numbering
needs to remember something: per scope, which values have which number. A text's new tokens come with
it, so that a sink can store them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.functions.hof import once
from veilspark.operators.detect import BUILT_IN, ColumnDetector, Detector, detect
from veilspark.operators.policy import LayeredPolicy, Policy
from veilspark.operators.redact import replaced, reported, splice, token_key, tokenized, with_actions

_ENTRIES = "array<struct<key:string,value:string>>"
#: Timestamps travel with microseconds.
_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _numbering(order: list[str], timeout_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
        else:
            known: dict[str, dict[str, int]] = json.loads(state.get[0]) if state.exists else {}
            grown = False
            rows = pd.concat(batches).sort_values(order, kind="stable", na_position="first")
            for keys, row in zip(rows["__keys"].tolist(), rows["__row"].tolist()):
                entries, fresh = [], []
                for k in json.loads(keys):
                    display, _, value = k.partition(" ")
                    numbers = known.setdefault(display, {})
                    if value not in numbers:
                        numbers[value], grown = len(numbers) + 1, True
                        fresh.append(k)
                    entries.append({"key": k, "value": f"[{display}_{numbers[value]}]"})
                out.append((row, json.dumps(entries), json.dumps(fresh)))
            if grown or (timeout_ms and state.exists):
                state.update((json.dumps(known),))
                if timeout_ms:
                    state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["row", "entries", "fresh"])

    return run


def redact_conversation_stream(
    texts: DataFrame,
    scope: Sequence[str],
    order: Sequence[str],
    text: str = "text",
    policy: Policy | LayeredPolicy | None = None,
    detectors: Sequence[Detector | ColumnDetector] = BUILT_IN,
    timeout_ms: int | None = None,
) -> DataFrame:
    """Streaming twin of ``redact_batch``: the texts' other columns, ``redacted, entities, blocked`` and
    ``new_tokens`` (``array<struct<placeholder,value>>``, those first met in this text).

    Texts are numbered by ``order`` (numbers or strings) inside a micro-batch and by arrival over
    micro-batches, so input that arrives in order gets the batch form's placeholders. State per scope is
    its distinct values; null scopes are one scope. Every text gets its row, also when blocked: a
    stream can not hold back what it has sent, so readers must drop scopes with a blocked row. With
    ``timeout_ms`` a scope idle for that long is forgotten and would start again from 1; such a query
    must not be run with an available-now trigger. Other columns travel as JSON.
    """
    scope, order = list(scope), list(order)
    found = detect(texts, text, detectors, "__spans")
    acted = with_actions(found, policy or Policy(), "__spans", "__acted").drop("__spans")
    keys = F.array_distinct(F.transform(F.filter("__acted", tokenized), token_key))
    packed = acted.select(
        *(F.col(c).alias(f"__scope_{i}") for i, c in enumerate(scope)),
        *(F.col(c).alias(f"__order_{i}") for i, c in enumerate(order)),
        F.to_json(F.coalesce(keys, F.array().cast("array<string>"))).alias("__keys"),
        F.to_json(F.struct(*acted.columns), _JSON).alias("__row"),
    )
    by = [f"__scope_{i}" for i in range(len(scope))]
    numbered = packed.groupBy(*by).applyInPandasWithState(
        _numbering([f"__order_{i}" for i in range(len(order))], timeout_ms),
        "row string, entries string, fresh string",
        "known string",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout,
    )
    opened = numbered.select(
        F.from_json("row", acted.schema, _JSON).alias("r"),
        F.from_json("entries", _ENTRIES).alias("__entries"),
        F.from_json("fresh", "array<string>").alias("__fresh"),
    ).select("r.*", "__entries", "__fresh")
    pieces = once(opened, "__pieces", replaced(F.col("__acted"), F.col("__entries")))
    fresh = F.transform(
        F.filter("__entries", lambda e: F.array_contains("__fresh", e["key"])),
        lambda e: F.struct(
            e["value"].alias("placeholder"),
            F.substring(e["key"], F.instr(e["key"], " ") + 1, F.length(e["key"])).alias("value"),
        ),
    )
    return pieces.withColumns(
        {
            "redacted": splice(F.col(text), F.col("__pieces")),
            "entities": reported(F.col("__pieces")),
            "blocked": F.exists("__acted", lambda s: s["action"] == "block"),
            "new_tokens": fresh,
        }
    ).drop("__pieces", "__entries", "__fresh", "__acted", text)
