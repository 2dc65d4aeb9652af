"""Byte chunks of a body to its text lines, wherever the body was cut.

A cut may fall inside a line or inside a character of several bytes. Pieces between line ends are put
together as bytes first and read as UTF-8 afterwards, so no cut changes a line. Only the first and
last piece of a chunk can belong to a line of several chunks; all others are lines as they stand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.lookup import join_null_safe
from veilspark.operators.staging import stage

RANGE_BITS = 12
#: One character for each byte, so that text functions work on bytes.
_BYTEWISE = "ISO-8859-1"


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def lines_of_chunks(chunks: DataFrame, ids: Sequence[str] = ("stream_id",), data: str = "bytes") -> DataFrame:
    """``ids, line_no, line`` from byte chunks ``ids, seq, bytes``; ``seq`` is unique in a body.

    Lines end at a line feed, which is not part of them; a carriage return is. What follows the last
    line feed is a line if there is any. A byte-order mark at the start of a body is dropped. Null and
    empty chunks add nothing, and a body without bytes has no lines. Null ids match themselves.

    A line's number is the count of line feeds before it: inside ranges of sequence numbers by a
    window, over ranges by their totals. So a body is spread over tasks, however long it is.
    """
    ids = list(ids)
    cut = F.split(F.decode(F.col(data), _BYTEWISE), "\n", -1)
    kept = chunks.where(F.octet_length(data) > 0).select(
        *ids, F.col("seq").cast("long").alias("seq"), cut.alias("__pieces")
    )
    ranged = kept.withColumn("__range", F.shiftright("seq", RANGE_BITS))
    inside = Window.partitionBy(*ids, "__range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    feeds = (F.size("__pieces") - 1).cast("long")
    # Written once: the totals of ranges and the pieces are two readers of it.
    local = stage(ranged.withColumn("__before", F.coalesce(F.sum(feeds).over(inside), F.lit(0))), "pieces")
    totals = local.groupBy(*ids, "__range").agg(F.sum(feeds).alias("__feeds"))
    earlier = Window.partitionBy(*ids).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*ids, "__range", F.coalesce(F.sum("__feeds").over(earlier), F.lit(0)).alias("__offset"))
    known = join_null_safe(local, offsets, [*ids, "__range"])
    pieces = known.select(
        *ids,
        "seq",
        (F.size("__pieces") - 1).alias("__last"),
        (F.col("__before") + F.col("__offset")).alias("__at"),
        F.posexplode("__pieces").alias("__k", "__piece"),
    ).withColumn("line_no", F.col("__at") + F.col("__k"))
    whole = (F.col("__k") > 0) & (F.col("__k") < F.col("__last"))
    middle = pieces.where(whole).select(*ids, "line_no", "__piece")
    ends = pieces.where(~whole).groupBy(*ids, "line_no").agg(
        F.sort_array(F.collect_list(F.struct("seq", "__piece"))).alias("__parts"),
        F.bool_or(F.col("__k") < F.col("__last")).alias("__ended"),
    )
    joined = ends.withColumn("__piece", F.array_join(F.transform("__parts", lambda p: p["__piece"]), ""))
    # The part behind the last line feed is a line only if it is not empty.
    closed = joined.where(F.col("__ended") | (F.col("__piece") != "")).select(*ids, "line_no", "__piece")
    text = decoded(F.encode("__piece", _BYTEWISE))
    marked = F.when(F.col("line_no") == 0, F.regexp_replace(text, "^\uFEFF", "")).otherwise(text)
    return middle.unionByName(closed).select(*ids, "line_no", marked.alias("line"))
