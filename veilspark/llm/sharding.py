"""Sharding by Karmarkar-Karp differencing: near-equal bytes per shard, equal texts kept together.

Rows with equal texts are one indivisible group. Groups of at least ``1 / BUNDLES`` of all bytes, at
most ``BUNDLES`` of them, stand alone; the others are dealt by their digest into ``BUNDLES`` bundles.
So differencing sees at most twice ``BUNDLES`` items whatever the size of the corpus, and its outcome
is a small table that every task looks up: texts are neither shuffled nor sorted, and a group that
holds a third of all rows is only one item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.staging import stage

BUNDLES = 20_000
ROWS_PER_BUCKET = 100_000
MIN_BUCKETS = 64


def difference(sizes: Sequence[int], shards: int) -> list[int]:
    """Give every item a shard. Each item starts as a partition of its own: itself and empty sets.

    The two partitions with the largest spread are combined, the largest set of one with the smallest
    of the other, until one is left. Ties go to the item that comes first.
    """
    if not sizes:
        return []
    # A partition: sums, largest first, and for each the tree of its items.
    heap = []
    for k, size in enumerate(sizes):
        sets = [(size, k)] + [(0, None)] * (shards - 1)
        heap.append((-size if shards > 1 else 0, k, sets))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, _, b = heap[0]
        joined = sorted(
            (
                (x + y, (s, t) if s is not None and t is not None else s if t is None else t)
                for (x, s), (y, t) in zip(a, reversed(b), strict=True)
            ),
            key=lambda p: -p[0],
        )
        heapq.heapreplace(heap, (joined[-1][0] - joined[0][0], first, joined))
    placed = [0] * len(sizes)
    for shard, (_, tree) in enumerate(heap[0][2]):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            elif node is not None:
                placed[node] = shard
    return placed


def text_key(text: Column) -> Column:
    """Digest of a text; all null texts share one that no text has."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"null"))


def _bundle(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUNDLES)).cast("int")


def plan_shards(items: DataFrame, shards: int) -> DataFrame:
    """``key, bundle, shard`` from rows ``key, size``. A standing-alone group has ``key`` set, a bundle
    has ``key`` null. At most twice ``BUNDLES`` rows."""
    groups = items.groupBy("key").agg(F.sum("size").alias("size"))
    groups = stage(groups, "groups")
    known = groups.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    alone = F.lit(True) if known.n <= BUNDLES else F.col("size") * BUNDLES >= F.lit(known.bytes or 0)
    parts = groups.select(
        F.when(alone, F.col("key")).alias("key"),
        F.when(~alone, _bundle(F.col("key"))).alias("bundle"),
        "size",
    )
    whole = parts.where(F.col("key").isNotNull())
    mixed = parts.where(F.col("key").isNull()).groupBy("key", "bundle").agg(F.sum("size").alias("size"))
    bounded = whole.unionByName(mixed).groupBy(F.lit(0).alias("one"))

    def assign(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["size", "key", "bundle"], ascending=[False, True, True], kind="stable")
        placed = difference([int(s) for s in batch["size"]], shards)
        return pd.DataFrame({"key": batch["key"], "bundle": batch["bundle"].astype("Int32"), "shard": placed})

    return bounded.applyInPandas(assign, "key binary, bundle int, shard int")


def with_slots(rows: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 in every shard, without sorting a shard in one task.

    Rows are numbered inside hash buckets of a shard; running counts of the buckets give the offsets.
    """
    rows = stage(rows, "placed")
    buckets = max(MIN_BUCKETS, rows.count() // ROWS_PER_BUCKET)
    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(shard).alias("__shard"),
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    inside = Window.partitionBy(shard, "__bucket").orderBy(*order)
    numbered = bucketed.withColumn("__row", F.row_number().over(inside))
    same = (F.col(shard) == F.col("__shard")) & (F.col("__bucket") == F.col("__b"))
    return (
        numbered.join(offsets, same)
        .withColumn("slot", F.col("__offset") + F.col("__row") - 1)
        .drop("__bucket", "__b", "__shard", "__offset", "__row")
    )


def shard_rows(df: DataFrame, ids: Sequence[str] = ("doc_id",), text: str = "text", shards: int = 8) -> DataFrame:
    """``ids, size, text_crc32, shard, slot`` for every row of ``df``; near-equal bytes per shard.

    ``size`` is the UTF-8 length of the text plus 1, so 1 for null and empty texts. All null texts are
    one group, apart from the empty ones; ``text_crc32`` is null for them. Rows with equal texts, so
    also repeated rows, share a shard and get a slot each. Null ids are kept. Other columns of ``df``
    are not looked at. An empty table gives an empty table.
    """
    t = F.col(text)
    items = stage(
        df.select(
            *ids,
            (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(t).alias("text_crc32"),
            text_key(t).alias("key"),
        ),
        "items",
    )
    plan = stage(plan_shards(items, shards), "shards")
    # Bounded by twice BUNDLES rows, so both sides may be broadcast at any size of the corpus.
    alone = plan.where(F.col("key").isNotNull()).select(F.col("key"), F.col("shard").alias("__alone"))
    mixed = plan.where(F.col("key").isNull()).select("bundle", F.col("shard").alias("__mixed"))
    placed = (
        items.withColumn("bundle", _bundle(F.col("key")))
        .join(F.broadcast(alone), "key", "left")
        .join(F.broadcast(mixed), "bundle", "left")
        .select(*ids, "size", "text_crc32", F.coalesce("__alone", "__mixed").alias("shard"))
    )
    return with_slots(placed, "shard", [*ids, "text_crc32"])
