"""Rehydration of chunked text, as a batch job.

A placeholder may be split over chunks, so the tail of a chunk that could still become one is held
back and put in front of the next chunk. A held tail is at most ``max_hold`` characters, and what is
held after a chunk is decided by the last ``max_hold`` characters of the text so far. So a chunk needs
only its nearest non-empty predecessors, not the whole stream: a bounded window gives them, and
streams are cut into ranges of sequence numbers so that one long stream is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import patterns as p
from veilspark.functions.kinds import MAX_STREAM_HOLD
from veilspark.operators.lookup import ROW, attach_values, join_null_safe, numbered_rows
from veilspark.operators.rehydrate import rehydrate, tokens_in
from veilspark.operators.staging import stage

RANGE_BITS = 12
#: Chunks that one task sorts.
TASK_CHUNKS = 500_000
_STREAM = ["stream_id", "choice", "tool_idx"]
_KEY = ["stream_id", "__seq_key"]


def sequence_key(choice: str = "choice", tool_idx: str = "tool_idx") -> Column:
    """Content of a choice, or arguments of one of its tool calls: separate sequences."""
    return F.concat_ws(":", F.coalesce(F.col(choice), F.lit(0)), F.col(tool_idx))


def held_tail(text: Column, max_hold: int) -> Column:
    """The end of the text that could still grow into a placeholder; empty when it is too long."""
    tail = F.regexp_extract(text, p.OPEN_PLACEHOLDER, 0)
    return F.when(F.length(tail) <= max_hold, tail).otherwise("")


def restored_texts(rows: DataFrame, text: str, out: str, maps: DataFrame | None, tokens: DataFrame | None) -> DataFrame:
    """Rows of streams with ``out``, their text restored from ``maps`` (``stream_id, token_map``) or from
    token rows (``stream_id, placeholder, value``) of any size. Only texts with a bracket look anything up."""
    may = F.contains(text, F.lit("["))
    plain = rows.where(~may).withColumn(out, F.col(text))
    if tokens is None:
        known = join_null_safe(rows.where(may), maps.select("stream_id", "token_map"), ["stream_id"], "left")
        return known.withColumn(out, rehydrate(F.col(text), F.col("token_map"))).drop("token_map").unionByName(plain)
    keyed = stage(numbered_rows(rows.where(may).withColumn("__keys", F.array_distinct(tokens_in(F.col(text))))), "keyed")
    found = attach_values(keyed, "__keys", tokens, ("stream_id",), "placeholder", "value", "__map")
    return found.withColumn(out, rehydrate(F.col(text), F.col("__map"))).drop("__map", "__keys", ROW).unionByName(plain)


def rehydrate_chunks(
    chunks: DataFrame,
    maps: DataFrame | None = None,
    max_hold: int = MAX_STREAM_HOLD,
    enabled: bool = True,
    flush_at_end: bool = True,
    tokens: DataFrame | None = None,
    range_bits: int = RANGE_BITS,
) -> DataFrame:
    """``stream_id, seq, choice, tool_idx, text, flushed`` from chunk rows.

    ``chunks``: ``stream_id, seq, choice, tool_idx, fragment, finished, done``; ``maps``:
    ``stream_id, token_map``, or ``tokens``, rows ``stream_id, placeholder, value`` as a vault holds them.
    Streams are cut into ranges of ``2 ** range_bits`` sequence numbers. A ``finished`` row releases the tail of its own sequence, a ``done`` row
    all tails of its stream, as extra rows marked ``flushed``. A stream that just stops releases its
    tails after its last row unless ``flush_at_end`` is off. Without ``enabled`` chunks pass unchanged.
    """
    content = chunks.where(~F.coalesce(F.col("done"), F.lit(False)))
    if not enabled:
        return content.select(*_STREAM[:1], "seq", *_STREAM[1:], F.col("fragment").alias("text"), F.lit(False).alias("flushed"))

    rows = (
        content.withColumn("__seq_key", sequence_key())
        .withColumn("finished", F.coalesce(F.col("finished"), F.lit(False)))
        .withColumn("fragment", F.coalesce(F.col("fragment"), F.lit("")))
        # A finished sequence starts anew; a line break can not be part of a held tail.
        .withColumn("__text", F.concat("fragment", F.when(F.col("finished"), "\n").otherwise("")))
        .withColumn("__range", F.shiftright(F.col("seq").cast("long"), range_bits))
    )
    filled = rows.where(F.col("__text") != "")
    blank = rows.where(F.col("__text") == "")

    near = F.right("__text", F.lit(max_hold))
    by_range = Window.partitionBy(*_KEY, "__range").orderBy("seq")
    inside = by_range.rowsBetween(-max_hold, -1)
    tasks = -(-filled.count() // TASK_CHUNKS)
    # Chunks are small rows that compress well, so tasks are cut by rows; by size a few would hold them all.
    dealt = filled.repartition(tasks, *_KEY, "__range") if tasks > 1 else filled
    # Written once: the ends of ranges and the chunks themselves are two readers of it.
    local = stage(
        dealt.withColumns(
            {
                "__before": F.array_join(F.collect_list(near).over(inside), ""),
                "__last": F.lead(F.lit(True)).over(by_range).isNull() & F.col("seq").isNotNull(),
            }
        ),
        "chunks",
    )
    ends = local.where("__last").select(*_KEY, "__range", F.right(F.concat("__before", near), F.lit(max_hold)).alias("__end"))
    ranges = Window.partitionBy(*_KEY).orderBy("__range")
    earlier = ranges.rowsBetween(-max_hold, -1)
    # Only streams of several ranges have anything to carry over.
    incoming = ends.select(
        *_KEY,
        "__range",
        F.array_join(F.collect_list("__end").over(earlier), "").alias("__in"),
        F.lead(F.lit(True)).over(ranges).isNotNull().alias("__more"),
    ).where((F.col("__in") != "") | F.col("__more"))
    known = join_null_safe(local, incoming, [*_KEY, "__range"], "left").withColumns(
        {"__in": F.coalesce("__in", F.lit("")), "__last": F.col("__last") & ~F.coalesce("__more", F.lit(False))}
    )
    before = F.right(F.concat("__in", "__before"), F.lit(max_hold))
    buffered = known.withColumn("__buffer", F.concat(held_tail(before, max_hold), "fragment")).withColumn(
        "__held", F.when(F.col("finished"), "").otherwise(held_tail(F.col("__buffer"), max_hold))
    )
    safe = F.substring("__buffer", F.lit(1), F.length("__buffer") - F.length("__held"))
    buffered = stage(buffered.withColumn("__safe", safe).drop("__before", "__in", "__more", "__text"), "buffered")
    shown = ["stream_id", "seq", "choice", "tool_idx", "text", "flushed"]
    safe_rows = buffered.select(*shown[:4], "__safe")
    emitted = restored_texts(safe_rows, "__safe", "text", maps, tokens).withColumn("flushed", F.lit(False))
    silent = blank.withColumn("text", F.lit("")).withColumn("flushed", F.lit(False))

    # What is still held after the last chunk of a sequence.
    last = buffered.where("__last").select(*shown[:4], F.col("__held").alias("text")).where(F.col("text") != "")
    closed = chunks.where("done").groupBy("stream_id").agg(F.max("seq").alias("__done"))
    tails = join_null_safe(last, closed, ["stream_id"], "left" if flush_at_end else "inner")
    flushed = tails.withColumn("seq", F.coalesce("__done", "seq")).withColumn("flushed", F.lit(True))
    return emitted.select(*shown).unionByName(silent.select(*shown)).unionByName(flushed.select(*shown))
