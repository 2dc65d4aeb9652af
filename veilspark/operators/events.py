"""Event streams as received: every line comes back, with its texts restored in place.

A reply arrives as event lines whose payload is a JSON object. The texts inside go through chunk
rehydration, because a placeholder may be split over lines, and return to the places they came from;
ids, models, roles, finish reasons, usage and anything else stay. What is still held when a stream is
marked as done becomes frames of its own in front of the end marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.hof import let
from veilspark.functions.kinds import MAX_STREAM_HOLD
from veilspark.operators.chunks import RANGE_BITS, rehydrate_chunks
from veilspark.operators.lookup import join_null_safe
from veilspark.operators.messages import edit_elements, edit_field, kind_of
from veilspark.operators.staging import stage
from veilspark.sources.chunks import event_payloads, synthetic_frame

#: Texts of one line are numbered within the line: its place is the upper part of their sequence number.
PART_BITS = 20
PREFIX = "data: "


def edited_payload(payload: Column, edits: Column) -> Column:
    """The payload with the texts of ``edits`` (``choice`` or ``choice:call`` places to text) put in place.

    A content that is not there is added only when there is text for it.
    """

    def found(*places: Column) -> Column:
        return F.try_element_at(edits, F.concat_ws(":", *places))

    def content(v: Column, i: Column) -> Column:
        return let(found(i), lambda new: F.when((kind_of(v) == "STRING") | (new != ""), new.cast("variant")))

    def call(v: Column, i: Column, j: Column) -> Column:
        return edit_field(v, "function", lambda f: edit_field(f, "arguments", lambda _: found(i, j).cast("variant")))

    def calls(v: Column, i: Column) -> Column:
        return edit_elements(v, lambda c, j: F.when(found(i, j).isNotNull(), call(c, i, j)).otherwise(c))

    def delta(v: Column, i: Column) -> Column:
        spoken = let(edit_field(v, "content", lambda c: content(c, i)), lambda d: edit_field(d, "tool_calls", lambda ts: calls(ts, i)))
        return F.when(kind_of(v).startswith("OBJECT"), spoken)

    def choices(v: Column) -> Column:
        return edit_elements(v, lambda c, i: edit_field(c, "delta", lambda d: delta(d, i)))

    return let(F.parse_json(payload), lambda body: F.to_json(edit_field(body, "choices", choices)))


def rehydrate_events(
    lines: DataFrame,
    maps: DataFrame | None = None,
    tokens: DataFrame | None = None,
    max_hold: int = MAX_STREAM_HOLD,
    enabled: bool = True,
    flush_at_end: bool = True,
) -> DataFrame:
    """``stream_id, seq, part, line``: the ``data:`` lines of event streams, texts restored.

    ``lines``: ``stream_id, seq, line``, with ``seq`` from 0 and unique in a stream; ``maps`` and
    ``tokens`` as in chunk rehydration. A received line has part 0. Tails still held at the end marker
    come as frames with negative parts in front of it; those of a stream that just stops, as frames
    behind its last text, unless ``flush_at_end`` is off. Read lines by ``seq`` and ``part``.
    Payloads that are not JSON, and those whose texts do not change, stay as they are to the byte; an
    edited one is written again with its keys sorted. Blank lines and comments are dropped. Without
    ``enabled`` all ``data:`` lines pass unchanged.
    """
    if not enabled:
        received = event_payloads(lines.select("stream_id", "seq", "line"))
        return received.select("stream_id", "seq", F.lit(0).alias("part"), F.concat(F.lit(PREFIX), "payload").alias("line"))
    received = stage(event_payloads(lines.select("stream_id", "seq", "line")), "events")
    exploded = received.select("stream_id", "seq", "done", F.posexplode_outer("parts").alias("k", "c"))
    number = F.shiftleft(F.col("seq").cast("long"), PART_BITS) + F.coalesce("k", F.lit(0))
    chunks = exploded.where(F.col("done") | F.col("c").isNotNull()).select(
        "stream_id", number.alias("seq"), "c.choice", "c.tool_idx", "c.fragment", "c.finished", "done"
    )
    emitted = stage(
        rehydrate_chunks(chunks, maps, max_hold, True, flush_at_end, tokens, RANGE_BITS + PART_BITS), "emitted"
    ).withColumns({"k": F.col("seq").bitwiseAND((1 << PART_BITS) - 1).cast("int"), "seq": F.shiftright("seq", PART_BITS)})

    texts = emitted.where(~F.col("flushed")).groupBy("stream_id", "seq").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "text"))).alias("__texts")
    )
    joined = join_null_safe(received, texts, ["stream_id", "seq"], "left")
    known = F.transform(
        "parts",
        lambda p, k: F.struct(
            F.concat_ws(":", p["choice_at"], p["call_at"]).alias("at"),
            F.try_element_at("__texts", k).alias("text"),
            F.coalesce(p["fragment"], F.lit("")).alias("old"),
        ),
    )
    changed = joined.withColumn("__new", known)
    edits = F.map_from_entries(F.transform("__new", lambda p: F.struct(p["at"], p["text"])))
    moved = F.exists("__new", lambda p: p["text"] != p["old"])
    line = F.when(moved, edited_payload(F.col("payload"), edits)).otherwise(F.col("payload"))
    own = changed.select("stream_id", "seq", F.lit(0).alias("part"), F.concat(F.lit(PREFIX), line).alias("line"))

    # The sequences of one stream that hold something at its end: content first, then calls.
    group = Window.partitionBy("stream_id", "seq")
    place = F.row_number().over(group.orderBy(F.col("tool_idx").isNotNull(), "choice", "tool_idx"))
    tails = emitted.where("flushed").withColumns({"__place": place, "__n": F.count("*").over(group)})
    ends = received.where("done").groupBy("stream_id").agg(F.max("seq").alias("__end"))
    closed = join_null_safe(tails, ends, ["stream_id"], "left")
    part = F.when(F.col("seq") == F.col("__end"), F.col("__place") - F.col("__n") - 1).otherwise(F.col("__place"))
    frame = synthetic_frame(F.col("choice"), F.col("tool_idx"), F.col("text"))
    return own.unionByName(closed.select("stream_id", "seq", part.cast("int").alias("part"), frame.alias("line")))
