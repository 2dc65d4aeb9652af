"""Spans: where a pattern matched in a text. Offsets count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as p
from veilspark.functions.hof import empty, let, running
from veilspark.functions.kinds import SPANS


#: Pieces of a text up to which the lengths before each match are added up anew.
FEW_PIECES = 25


def span(kind: Column, start: Column, end: Column, value: Column, label: Column, rank: Column) -> Column:
    return F.struct(
        kind.alias("type"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        value.alias("value"),
        label.cast("string").alias("label"),
        rank.cast("int").alias("rank"),
    )


def place(matches: Column, values: Column, gaps: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """Offsets of the matches of one pattern, as spans.

    ``matches`` are all whole matches in order and ``gaps`` the text between them (``split`` by the
    same pattern); their lengths add up to the offsets. ``values`` are the parts that count as the
    span, each ending where its match ends. Empty matches move the position but give no span.
    """
    # A zero-width match at the very start gives no leading gap.
    aligned = F.when(F.size(gaps) > F.size(matches), gaps).otherwise(F.concat(F.array(F.lit("")), gaps))
    items = F.zip_with(
        F.zip_with(
            F.slice(aligned, F.lit(1), F.size(matches)),
            matches,
            lambda g, m: F.struct((F.length(g) + F.length(m)).alias("step"), F.length(m).alias("len")),
        ),
        values,
        lambda s, v: F.struct(s["step"].alias("step"), s["len"].alias("len"), v.alias("v")),
    )

    def step(pos: Column, item: Column) -> tuple[Column, Column]:
        end = pos + item["step"]
        one = make(end - F.length(item["v"]), end, item["v"])
        return end, F.when(item["len"] > 0, F.array(one)).otherwise(empty(SPANS))

    return running(items, F.lit(0), step, SPANS)


def interleaved(matches: Column, values: Column | None, gaps: Column) -> Column:
    """Gap, match and, if given, value of every match in turn, and a last piece."""
    aligned = F.when(F.size(gaps) > F.size(matches), gaps).otherwise(F.concat(F.array(F.lit("")), gaps))
    turns = F.zip_with(F.slice(aligned, F.lit(1), F.size(matches)), matches, lambda g, m: F.array(g, m))
    if values is not None:
        turns = F.zip_with(turns, values, lambda gm, v: F.concat(gm, F.array(v)))
    return F.concat(F.flatten(turns), F.array(F.lit("")))


def place_pieces(pieces: Column, stride: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """Offsets of the matches of one pattern, as spans, like :func:`place`, from the pieces of a text.

    For every match there are ``stride`` pieces: the gap before it, the match and, with a stride of 3,
    the part that counts as the span; one more piece ends the array. Few pieces are added up for each
    match, which is cheaper than a fold that carries its results; many go through the fold.
    """

    def few(p: Column) -> Column:
        def of(sizes: Column) -> Column:
            def one(i: Column) -> Column:
                end = F.aggregate(F.slice(sizes, F.lit(1), i * stride + 2), F.lit(0), lambda n, x: n + x)
                v = F.get(p, i * stride + stride - 1)
                return let(end, lambda e: make(e - F.length(v), e, v))

            return F.transform(F.filter(F.sequence(F.lit(0), last(p)), lambda i: F.get(sizes, i * stride + 1) > 0), one)

        # With a stride of 3, every third piece repeats a part of the match.
        return let(F.transform(p, lambda x, j: F.when((stride == 3) & (j % 3 == 2), 0).otherwise(F.length(x))), of)

    def last(p: Column) -> Column:
        return F.floor((F.size(p) - 1) / stride).cast("int") - 1

    def items(p: Column) -> Column:
        def one(i: Column) -> Column:
            n = F.length(F.get(p, i * stride + 1))
            return F.struct(
                (F.length(F.get(p, i * stride)) + n).alias("step"), n.alias("len"), F.get(p, i * stride + stride - 1).alias("v")
            )

        return F.transform(F.sequence(F.lit(0), last(p)), one)

    def step(pos: Column, item: Column) -> tuple[Column, Column]:
        end = pos + item["step"]
        one = make(end - F.length(item["v"]), end, item["v"])
        return end, F.when(item["len"] > 0, F.array(one)).otherwise(empty(SPANS))

    return F.when(F.size(pieces) <= FEW_PIECES, let(pieces, few)).otherwise(running(let(pieces, items), F.lit(0), step, SPANS))


def luhn_ok(digits: Column) -> Column:
    """13 to 19 digits whose mod-10 check holds."""
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def cards_in_groups(text: Column) -> Column:
    """``array<struct<start,end>>``: card numbers made of whole digit groups, wherever they stand in a row of
    groups. The leftmost wins, then the longest; cards do not overlap.

    A row of groups is cut into groups once; a window is a run of groups with 13 to 19 digits, so a
    group starts at most 19 windows, however long the row is.
    """
    none = F.lit(None)
    rows = F.regexp_extract_all(text, F.lit(p.DIGIT_GROUPS), F.lit(0))
    placed = place(rows, rows, F.split(text, p.DIGIT_GROUPS, -1), lambda s, e, v: span(none.cast("string"), s, e, v, none, F.lit(0)))
    long = F.filter(placed, lambda s: F.length(F.translate(s["value"], " -", "")) >= 13)

    def windows(row: Column) -> Column:
        def of(groups: Column) -> Column:
            # Every separator is one character, so a group starts behind the lengths of those before it.
            def starting(i: Column) -> Column:
                few = F.slice(groups, i + 1, F.lit(19))

                def ending(n: Column) -> Column:
                    part = F.slice(few, F.lit(1), n)
                    digits = F.array_join(part, "")
                    return F.when(luhn_ok(digits), F.length(digits) + n - 1)

                sizes = F.array_compact(F.transform(F.sequence(F.lit(1), F.size(few)), ending))
                return F.when(F.size(sizes) > 0, F.element_at(sizes, -1))

            def step(at: Column, g: Column) -> tuple[Column, Column]:
                # State: where the next group starts, and where the last card ended.
                start, last = at["start"], at["last"]
                size = F.when(start >= last, g["size"])
                end = start + F.coalesce(size, F.lit(0))
                nxt = F.struct(
                    (start + F.length(g["text"]) + 1).alias("start"), F.when(size.isNotNull(), end).otherwise(last).alias("last")
                )
                card = F.struct((row["start"] + start).alias("start"), (row["start"] + end).alias("end"))
                return nxt, F.when(size.isNotNull(), F.array(card)).otherwise(empty("array<struct<start:int,end:int>>"))

            items = F.transform(groups, lambda g, i: F.struct(g.alias("text"), starting(i).alias("size")))
            state = F.struct(F.lit(0).alias("start"), F.lit(0).alias("last"))
            return running(items, state, step, "array<struct<start:int,end:int>>")

        return let(F.split(row["value"], "[ -]"), of)

    return F.flatten(F.transform(long, windows))


def is_card(value: Column) -> Column:
    return luhn_ok(F.translate(value, " -", ""))
