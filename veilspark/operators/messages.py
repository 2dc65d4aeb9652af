"""Chat messages: flatten requests into text rows, put redacted texts back, rehydrate replies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.hof import let
from veilspark.operators.lookup import ROW, attach_values, join_null_safe, numbered_rows
from veilspark.operators.rehydrate import rehydrate, tokens_in
from veilspark.operators.staging import stage


def flatten_messages(df: DataFrame, body: str = "body", ids: Sequence[str] = ("conv_id",)) -> DataFrame:
    """``ids, msg_idx, part_idx, role, text`` from a JSON request ``{"messages": [...]}``.

    A string content gives one row with a null ``part_idx``; a list of parts gives one row per part
    of type ``text`` that holds a string. Anything else is skipped. Whether a value is a JSON string
    is decided on the variant, so numbers and objects are not taken for text.
    """
    parsed = df.select(*ids, F.expr(f"try_parse_json({body})").alias("v"))
    messages = parsed.select(
        *ids, F.posexplode(F.expr("try_variant_get(v, '$.messages', 'array<variant>')")).alias("msg_idx", "m")
    )
    content = messages.select(
        *ids,
        "msg_idx",
        F.expr("try_variant_get(m, '$.role', 'string')").alias("role"),
        F.expr("try_variant_get(m, '$.content', 'variant')").alias("c"),
    )
    kind = F.coalesce(F.expr("schema_of_variant(c)"), F.lit("VOID"))
    one = "array(struct(cast(null as int) as part_idx, cast(c as string) as text))"
    many = (
        "filter(transform(cast(c as array<variant>), (p, i) -> struct(i as part_idx, "
        "CASE WHEN schema_of_variant(p) LIKE 'OBJECT%' "
        "AND try_variant_get(p, '$.type', 'string') = 'text' "
        "AND schema_of_variant(try_variant_get(p, '$.text', 'variant')) = 'STRING' "
        "THEN try_variant_get(p, '$.text', 'string') END as text)), x -> x.text IS NOT NULL)"
    )
    parts = F.when(kind == "STRING", F.expr(one)).when(kind.startswith("ARRAY"), F.expr(many))
    return content.select(*ids, "msg_idx", "role", F.explode(parts).alias("p")).select(
        *ids, "msg_idx", "p.part_idx", "role", "p.text"
    )


def reassemble_messages(
    texts: DataFrame, ids: Sequence[str] = ("conv_id",), text: str = "redacted"
) -> DataFrame:
    """``ids, msg_idx, role, content``: redacted texts back in their message slots.

    A message of parts gets its parts in order as a JSON list; a plain message its string. Grouping
    is per message, never per conversation, so one huge conversation stays spread out.
    """
    part = F.struct("part_idx", F.lit("text").alias("type"), F.col(text).alias("text"))
    grouped = texts.groupBy(*ids, "msg_idx").agg(
        F.any_value("role").alias("role"), F.sort_array(F.collect_list(part)).alias("parts")
    )
    listed = F.to_json(F.transform("parts", lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"))))
    whole = F.col("parts")[0]
    content = F.when(whole["part_idx"].isNull(), whole["text"]).otherwise(listed)
    return grouped.select(*ids, "msg_idx", "role", content.alias("content"))


def kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(v: Column, name: str) -> Column:
    return F.when(kind_of(v).startswith("OBJECT"), F.try_variant_get(v, f"$.{name}", "variant"))


def edit_field(v: Column, name: str, edit: Callable[[Column], Column]) -> Column:
    """The object variable ``v`` with one field edited; unchanged where ``edit`` gives null."""

    def put(new: Column) -> Column:
        others = F.map_filter(v.cast("map<string,variant>"), lambda k, _: k != name)
        changed = F.to_variant_object(F.map_concat(others, F.create_map(F.lit(name), new)))
        return F.when(new.isNotNull(), changed).otherwise(v)

    return let(let(_field(v, name), edit), put)


def edit_elements(v: Column, edit: Callable[..., Column]) -> Column:
    """A variant array with ``edit`` applied to its elements, and to their places if it takes two
    arguments; null for anything else."""
    edited = F.transform(v.cast("array<variant>"), edit)
    return F.when(kind_of(v).startswith("ARRAY"), F.to_variant_object(edited))


def write_back(
    bodies: DataFrame,
    texts: DataFrame,
    ids: Sequence[str] = ("conv_id",),
    body: str = "body",
    text: str = "redacted",
) -> DataFrame:
    """The request bodies with the flattened ``texts`` (``ids, msg_idx, part_idx, text``) put back in place.

    Only string contents and the ``text`` of parts change; other parts, names, null contents, tool
    calls and all other fields stay, and messages stay in order. A body without texts is unchanged.
    Texts meet per request, whose size the sender's request bounds. ``ids`` identify a request; null
    ids match themselves.
    """
    slot = F.concat_ws(":", "msg_idx", F.coalesce("part_idx", F.lit(-1)))
    edits = texts.groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.struct(slot.alias("slot"), F.col(text).alias("text")))).alias("__edits")
    )
    joined = join_null_safe(bodies, edits, ids, "left")

    def new_text(v: Column, i: Column, j: Column) -> Column:
        found = F.try_element_at("__edits", F.concat_ws(":", i, j))
        return F.when(kind_of(v) == "STRING", found.cast("variant"))

    def content(v: Column, i: Column) -> Column:
        parts = edit_elements(v, lambda part, j: edit_field(part, "text", lambda t: new_text(t, i, j)))
        return F.coalesce(new_text(v, i, F.lit(-1)), parts)

    def message(v: Column, i: Column) -> Column:
        return F.when(kind_of(v).startswith("OBJECT"), edit_field(v, "content", lambda c: content(c, i))).otherwise(v)

    edited = let(F.try_parse_json(body), lambda b: F.to_json(edit_field(b, "messages", lambda ms: edit_elements(ms, message))))
    return joined.withColumn(body, F.when(F.col("__edits").isNotNull(), edited).otherwise(F.col(body))).drop("__edits")


def rehydrate_replies(
    replies: DataFrame,
    tokens: DataFrame,
    scope: Sequence[str],
    reply: str = "reply",
    out: str = "restored",
    json_escape: bool = False,
) -> DataFrame:
    """Replies (JSON text) restored from token rows ``(scope…, placeholder, value)`` of any size.

    Each reply looks up only the placeholders it holds, also those written with JSON escapes. Null
    scopes match themselves; replies may repeat.
    """
    spelled = F.coalesce(F.to_json(F.try_parse_json(reply)), F.col(reply), F.lit(""))
    keyed = stage(numbered_rows(replies.withColumn("__keys", F.array_distinct(tokens_in(spelled)))), "keyed")
    found = attach_values(keyed, "__keys", tokens, scope, "placeholder", "value", "__map")
    return found.withColumn(out, rehydrate_reply(F.col(reply), F.col("__map"), json_escape)).drop("__map", "__keys", ROW)


def rehydrate_reply(reply: Column, token_map: Column, json_escape: bool = False) -> Column:
    """A chat-completion reply (JSON text) with its placeholders restored.

    Restored fields are the string content, the ``text`` of content parts, and tool-call
    ``arguments``; every other field is kept as it is. Values go into ``arguments`` raw;
    ``json_escape`` escapes them there. Text that is not a JSON reply with choices passes through.
    """

    def swap(v: Column, escape: bool = False) -> Column:
        restored = let(v.cast("string"), lambda text: rehydrate(text, token_map, escape))
        return F.when(kind_of(v) == "STRING", restored.cast("variant"))

    def content(v: Column) -> Column:
        return F.coalesce(swap(v), edit_elements(v, lambda part: edit_field(part, "text", lambda text: swap(text))))

    def function(v: Column) -> Column:
        return F.when(kind_of(v).startswith("OBJECT"), edit_field(v, "arguments", lambda a: swap(a, json_escape)))

    def calls(v: Column) -> Column:
        return edit_elements(v, lambda call: edit_field(call, "function", function))

    def message(v: Column) -> Column:
        changed = let(edit_field(v, "content", content), lambda m: edit_field(m, "tool_calls", calls))
        return F.when(kind_of(v).startswith("OBJECT"), changed)

    def choices(v: Column) -> Column:
        return edit_elements(v, lambda choice: edit_field(choice, "message", message))

    return let(
        F.try_parse_json(reply),
        lambda body: F.when(
            kind_of(_field(body, "choices")).startswith("ARRAY"), F.to_json(edit_field(body, "choices", choices))
        ).otherwise(reply),
    )
