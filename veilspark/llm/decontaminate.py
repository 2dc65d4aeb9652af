"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

Test items are short and documents long, so the resemblance of an item and a document is near zero
even when the item stands in it word for word, and sketches of documents do not help. The search is
therefore one-sided. Items are partitioned by the size of their shingle set. Every partition has one
sketch length, taken from its upper size and the threshold, and an item's sketch is that many of its
smallest min-wise hashes. A document that contains the item can miss only so many of its shingles, so
it must hold a known number of the sketch: no contained item is lost, unlike with banded sketches.

Documents send only the hashes that some sketch holds. Pairs with enough of them are verified on the
shingles themselves, as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shingles import with_shingle_hashes, with_shingles
from veilspark.operators.staging import stage

#: Sketch values beyond those that the threshold asks for; each raises the number of required hits.
SLACK = 2
#: Sketch rows and item shingles up to these numbers are broadcast (16 and about 60 bytes a row).
MAX_BROADCAST = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _least(size: Column, percent: int) -> Column:
    """Fewest shared shingles that reach the threshold."""
    return F.ceil(size * percent / 100)


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """``item_id, hash, need``: the min-wise sketch of every item and the hits a document must have."""
    hashes = with_shingle_hashes(items, "text", "__h").select("item_id", F.explode(F.array_distinct("__h")).alias("hash"))
    ordered = Window.partitionBy("item_id").orderBy("hash")
    of_item = Window.partitionBy("item_id")
    ranked = hashes.withColumns({"__k": F.row_number().over(ordered), "__n": F.count("*").over(of_item)})
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("__n").cast("double")))).cast("long")
    length = F.least(F.col("__n"), upper - _least(upper, percent) + 1 + SLACK)
    misses = F.col("__n") - _least(F.col("__n"), percent)
    kept = ranked.where(F.col("__k") <= length)
    return kept.select("item_id", "hash", F.greatest(length - misses, F.lit(1)).cast("int").alias("need"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    percent: int = 75,
) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` for every document that holds at least ``percent`` per
    cent of an item's distinct five-word shingles, and ``doc_hash``, which tells apart texts of one id.

    An item of fewer than five words is one shingle, found only in a document of just these words.
    Null, empty and blank items and documents match nothing. Items that repeat an id are one item
    each text; null ids are kept. Repeated documents give one row. Other columns are not looked at.
    """
    named = items.select(F.col(item_id).alias("__item"), F.col(item_text).alias("text")).distinct()
    named = named.withColumn("item_id", F.struct(F.col("__item"), F.xxhash64("text").alias("h")))
    named = stage(named, "items")
    sketch = stage(sketches(named, percent), "sketches")
    rows = docs.select(
        F.col(doc_id).alias("__doc"), F.xxhash64(text).alias("__hash"), F.col(text).alias("text")
    )
    hashes = with_shingle_hashes(rows, "text", "__h").select("__doc", "__hash", F.explode("__h").alias("hash"))
    hits = hashes.join(_small(sketch), "hash").groupBy("__doc", "__hash", "item_id")
    counted = hits.agg(F.count_distinct("hash").alias("n"), F.first("need").alias("need"))
    pairs = stage(counted.where("n >= need").select("__doc", "__hash", "item_id"), "candidates")

    spelled = with_shingles(named, "text", "__s").select(
        "item_id", F.array_distinct("__s").alias("__s"), F.size(F.array_distinct("__s")).alias("n_item")
    )
    spelled = spelled.select("item_id", "n_item", F.explode("__s").alias("shingle"))
    wanted = pairs.select(F.col("__doc").alias("__d"), F.col("__hash").alias("__g")).distinct()
    same = F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__g"))
    suspects = with_shingles(rows.join(wanted, same, "left_semi"), "text", "__s")
    shared = (
        suspects.select("__doc", "__hash", F.explode(F.array_distinct("__s")).alias("shingle"))
        .join(_small(stage(spelled, "shingles")), "shingle")
        .groupBy("__doc", "__hash", "item_id")
        .agg(F.count_distinct("shingle").alias("n_shared"), F.first("n_item").alias("n_item"))
    )
    match = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    both = ["__hash", "item_id"]
    known = pairs.select(F.col("__doc").alias("__d"), *both)
    found = match.join(known, both).where(F.col("__doc").eqNullSafe(F.col("__d")))
    return found.select(
        F.col("__doc").alias(doc_id),
        F.col("__hash").alias("doc_hash"),
        F.col("item_id.__item").alias(item_id),
        F.col("n_item").cast("long").alias("n_item"),
        "n_shared",
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns."""
    found = contained_items(docs, items, doc_id, text, **options)
    bad = found.select(F.col(doc_id).alias("__bad"), F.col("doc_hash").alias("__bad_hash")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("__bad")) & (F.xxhash64(text) == F.col("__bad_hash"))
    return docs.join(stage(bad, "leaks"), same, "left_anti")
