"""Overlap resolution: earliest start first, then the longer span, then detector order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.hof import empty, let, running
from veilspark.functions.kinds import SPANS


def sort_spans(spans: Column) -> Column:
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("a"), (-s["end"]).alias("b"), s["rank"].alias("c"), s["type"].alias("d"), s.alias("span")
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def resolve_overlaps(spans: Column) -> Column:
    """Non-overlapping spans in text order, chosen greedily from the left. In-row, no shuffle."""

    def step(last_end: Column, s: Column) -> tuple[Column, Column]:
        free = s["start"] >= last_end
        return (
            F.when(free, s["end"]).otherwise(last_end),
            F.when(free, F.array(s)).otherwise(empty(SPANS)),
        )

    chosen = let(sort_spans(spans), lambda xs: running(xs, F.lit(-1), step, SPANS))
    return F.when(F.size(spans) > 1, chosen).otherwise(spans)
