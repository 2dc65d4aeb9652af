"""Chunk streams: server-sent event lines to chunk rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.hof import let, once
from veilspark.sources.text import read_lines

CHUNK = "struct<choice:int,tool_idx:int,fragment:string,finished:boolean,choice_at:int,call_at:int>"


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Recorded replies, one file each: ``stream_id`` (the file), ``seq`` (the line) and ``line``. A long file
    is read by many tasks."""
    return read_lines(spark, path).select(F.col("path").alias("stream_id"), F.col("line_no").alias("seq"), F.col("text").alias("line"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _list(v: Column) -> Column:
    empty = F.array().cast("array<variant>")
    return F.when(_kind(v).startswith("ARRAY"), F.coalesce(v.cast("array<variant>"), empty)).otherwise(empty)


def _index(v: Column) -> Column:
    return F.when(_kind(_get(v, "index")).startswith("BIGINT"), _get(v, "index", "int")).otherwise(0)


def _chunk(choice: Column, tool: Column, text: Column, finished: Column, at: Column, call: Column) -> Column:
    return F.struct(
        choice.cast("int").alias("choice"),
        tool.cast("int").alias("tool_idx"),
        text.alias("fragment"),
        finished.alias("finished"),
        at.cast("int").alias("choice_at"),
        call.cast("int").alias("call_at"),
    )


def _of_choice(c: Column, at: Column) -> Column:
    finished = F.coalesce(_kind(_get(c, "finish_reason")) != "VOID", F.lit(False))
    delta = _get(c, "delta")
    none = F.lit(None)
    content = F.when(_kind(_get(delta, "content")) == "STRING", _get(delta, "content", "string"))
    spoken = F.array(_chunk(_index(c), none, content, finished, at, none))
    calls = F.filter(
        F.transform(
            _list(_get(delta, "tool_calls")),
            lambda t, i: _chunk(
                _index(c),
                _index(t),
                F.when(
                    _kind(_get(t, "function.arguments")) == "STRING", _get(t, "function.arguments", "string")
                ),
                finished,
                at,
                i,
            ),
        ),
        lambda x: x["fragment"].isNotNull(),
    )
    said = F.when(content.isNotNull() | finished, spoken).otherwise(F.array().cast(f"array<{CHUNK}>"))
    usable = _kind(delta).startswith("OBJECT")
    return F.when(usable, F.concat(said, calls)).otherwise(F.array().cast(f"array<{CHUNK}>"))


#: What ``\\s`` matches in a pattern of Java, and what else ``$`` lets stand behind the end of a line.
_BLANKS = " \t\n\x0b\f\r"
_ENDS = "\x85\u2028\u2029"


def _trimmed(line: Column) -> Column:
    """``line`` without blanks at its ends. A pattern runs only over lines with something to take away."""
    bare = F.btrim(line, F.lit(_BLANKS + _ENDS)) == line
    return F.when(bare, line).otherwise(F.regexp_replace(line, r"^\s+|\s+$", ""))


def payload_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that start with ``data:``, with their ``payload``. Other lines are dropped. Stateless."""
    trimmed = lines.withColumn("__line", _trimmed(F.col(line)))
    payload = F.ltrim(F.substring("__line", 6, 2_000_000_000), F.lit(_BLANKS))
    return trimmed.where(F.col("__line").startswith("data:")).withColumn("payload", payload).drop("__line", line)


def event_payloads(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that start with ``data:``, with ``payload``, ``done`` for the end marker, and ``parts``: the
    texts the payload holds, each with the places of its choice and tool call in their arrays.

    Other lines are dropped. A payload that is not JSON, or holds no text, has no parts. Stateless.
    """
    data = payload_lines(lines, line)
    done = F.col("payload") == "[DONE]"
    parsed = F.when(~done, F.try_parse_json("payload"))
    parts = let(parsed, lambda v: F.flatten(F.transform(_list(_get(v, "choices")), _of_choice)))
    return once(data.withColumn("done", done), "parts", parts)


def parse_chunk_lines(lines: DataFrame, ids: Sequence[str] = ("stream_id",), line: str = "line") -> DataFrame:
    """``ids, seq, choice, tool_idx, fragment, finished, done, passthrough`` from event lines.

    Lines that do not start with ``data:`` are dropped. ``[DONE]`` gives a ``done`` row. A payload
    that is not JSON, or holds no text, gives one row with the payload in ``passthrough``. Stateless,
    so it serves batch and streaming input alike.
    """
    rows = event_payloads(lines.select(*ids, "seq", F.col(line).alias("line")))
    silent = F.coalesce(F.size("parts"), F.lit(0)) <= 0
    return rows.select(
        *ids,
        "seq",
        F.explode_outer("parts").alias("c"),
        "done",
        F.when(~F.col("done") & silent, F.col("payload")).alias("passthrough"),
    ).select(*ids, "seq", "c.choice", "c.tool_idx", "c.fragment", "c.finished", "done", "passthrough")


def synthetic_frame(choice: Column, tool: Column, text: Column) -> Column:
    """An event line that carries one text: content of a choice, or arguments of one of its tool calls."""
    index = F.coalesce(choice, F.lit(0)).alias("index")
    spoken = F.struct(index, F.struct(text.alias("content")).alias("delta"))
    call = F.struct(tool.alias("index"), F.struct(text.alias("arguments")).alias("function"))
    called = F.struct(index, F.struct(F.array(call).alias("tool_calls")).alias("delta"))

    def line(c: Column) -> Column:
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(c).alias("choices"))))

    return F.when(tool.isNull(), line(spoken)).otherwise(line(called))


def chunk_frames(emitted: DataFrame, chunks: DataFrame) -> DataFrame:
    """``stream_id, seq, part, line``: rehydrated chunk rows as event lines, for streams that came as rows.

    Streams that came as lines keep them: see ``rehydrate_events``. Content becomes a ``delta`` of its
    choice, arguments those of their tool call; a released tail is a frame of its own at the place of the
    end marker, in front of ``data: [DONE]``. Lines are in order by ``seq`` and ``part``. Empty texts
    give no line.
    """
    frames = emitted.where(F.col("text") != "").select(
        "stream_id",
        "seq",
        F.col("flushed").cast("int").alias("part"),
        synthetic_frame(F.col("choice"), F.col("tool_idx"), F.col("text")).alias("line"),
    )
    ends = chunks.where("done").select("stream_id", "seq", F.lit(2).alias("part"), F.lit("data: [DONE]").alias("line"))
    return frames.unionByName(ends)
