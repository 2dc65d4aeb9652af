"""Placeholder numbering across rows: one tokenizer over the texts of a scope, in order.

The reference order is "first occurrence". Per scope and display label, distinct values are numbered
1, 2, 3… by the position of their first occurrence. A scope may be a conversation or the whole table,
so a window over a scope is not an option. Instead all values are dealt to ranges of scope, label and
full order key, written with the number of their range, and numbered inside it; a range's offset is
the running count of the ranges before it. However large one scope or one conversation is, no window
sees more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.labels import placeholder
from veilspark.operators.lookup import join_null_safe
from veilspark.operators.staging import stage

def distinct_values(occurrences: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``scope, display, value, order…, n``: each value's first position and how often it occurs.

    Partial aggregation folds repeats before the shuffle, so a value in most rows costs little.
    """
    first = F.min(F.struct(*order)).alias("__first")
    grouped = occurrences.groupBy(*scope, "display", "value").agg(first, F.count("*").alias("n"))
    return grouped.select(*scope, "display", "value", *(F.col(f"__first.{o}").alias(o) for o in order), "n")


def with_rank(df: DataFrame, order: Sequence[str], out: str = "rank") -> DataFrame:
    """Add the rows' places, from 1, in the order of the columns ``order`` over the whole table.

    Rows are dealt to ranges of the order and numbered inside them; a range's offset is the count of
    the ranges before it. Only one row a range meets in one task. Rows that are equal in ``order`` have
    places next to each other, in any order.
    """
    keys = [*order, "__tie"]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    dealt = stage(dealt.withColumn("__range", F.spark_partition_id()), "ranked")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__offset"))
    ranked = dealt.withColumn("__inside", inside).join(F.broadcast(offsets), "__range")
    return ranked.withColumn(out, (F.col("__inside") + F.col("__offset")).cast("long")).drop(
        "__range", "__tie", "__inside", "__offset"
    )


def number_values(values: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``placeholder`` to the rows of :func:`distinct_values`. Null scopes are a scope."""
    group = [*scope, "display"]
    # Written, so that every reader sees the same ranges.
    dealt = values.repartitionByRange(*group, *order, "value").withColumn("__range", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    inside = Window.partitionBy(*group, "__range").orderBy(*order, "value")
    ranked = dealt.withColumn("__rank", F.row_number().over(inside))
    counts = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__offset"))
    numbered = join_null_safe(ranked, offsets, [*group, "__range"])
    number = (F.col("__rank") + F.col("__offset")).cast("long")
    return numbered.select(*scope, "display", "value", "n", placeholder(F.col("display"), number).alias("placeholder"))
