"""Lookup of many keys per row in a keyed table, safe for keys that most rows share.

Rows list distinct keys; the table holds one value per key. Keys are split by how often they occur:
the few that make up a large share of all occurrences go through a broadcast, the long tail through
a shuffle join. The broadcast side is bounded: a key is hot only above ``1 / HOT_KEYS`` of all
occurrences, so at most ``HOT_KEYS`` keys can be.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.staging import stage

def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the columns ``on`` where null equals null; the columns of ``left`` are kept."""
    named = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    same = reduce(and_, (left[c].eqNullSafe(named[f"__right_{c}"]) for c in on))
    return left.join(named, same, how).drop(*(f"__right_{c}" for c in on))


HOT_KEYS = 1_000
MIN_HOT = 10_000


def hot_threshold(total: int) -> int:
    return max(MIN_HOT, total // HOT_KEYS)


def join_hot(occurrences: DataFrame, table: DataFrame, on: Sequence[str], count: str) -> DataFrame:
    """Inner join of occurrence rows to ``table``, whose ``count`` column says how often a key occurs.

    ``table`` should be staged: it is read for the total, for the hot keys and for the join.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    limit = hot_threshold(total)
    if total < limit:
        return join_null_safe(occurrences, table.drop(count), on)
    hot = table.where(F.col(count) >= limit).drop(count)
    if hot.isEmpty():
        return join_null_safe(occurrences, table.drop(count), on)
    flagged = join_null_safe(occurrences, F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")
    warm = flagged.where("__hot").drop("__hot")
    cold_rows = flagged.where(F.col("__hot").isNull()).select(*occurrences.columns)
    cold = join_null_safe(cold_rows, table.where(F.col(count) < limit).drop(count), on)
    return warm.unionByName(cold)


ROW = "__row"


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Add a number that no two rows share. Stage the result, so that every reader sees the same numbers."""
    return rows.withColumn(ROW, F.monotonically_increasing_id())


def attach_values(
    rows: DataFrame,
    keys: str,
    table: DataFrame,
    on: Sequence[str],
    key: str,
    value: str,
    out: str,
) -> DataFrame:
    """Add ``out``, a map from each of the row's ``keys`` to its table value. Null ``on`` values match themselves.

    ``rows`` are staged :func:`numbered_rows` with the columns ``on`` and the array column ``keys``: a
    row is known by its number, so ids may be null or repeat. ``table`` holds ``on``, ``key`` and
    ``value``, unique per ``on`` and ``key``. Rows without keys skip every shuffle. A row's map is no
    larger than the row's own list of keys.
    """
    on = list(on)
    with_keys = rows.where(F.size(keys) > 0)
    without = rows.where(F.coalesce(F.size(keys), F.lit(0)) <= 0)
    pairs = with_keys.select(ROW, *on, F.explode(F.array_distinct(keys)).alias(key))
    counts = pairs.groupBy(*on, key).agg(F.count("*").alias("__n"))
    used = stage(join_null_safe(counts, table.select(*on, key, value), [*on, key]), "lookup")
    joined = join_hot(pairs, used, [*on, key], "__n")
    maps = joined.groupBy(ROW).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value)))).alias(out)
    )
    found = with_keys.join(maps, ROW, "left")
    nothing = F.lit(None).cast(maps.schema[out].dataType)
    return found.unionByName(without.withColumn(out, nothing))
