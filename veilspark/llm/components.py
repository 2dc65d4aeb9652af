"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.staging import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node with an edge; the label is the smallest node of its component.

    Every round takes the smallest label of all neighbours and then the label of the label, so the
    number of rounds grows with the logarithm of the longest shortest path in practice. Labels are
    written after each round: plans stay short, and a lost executor costs one round. Nodes with many
    neighbours are folded by partial aggregation.
    """
    pairs = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where(F.col("src") != F.col("dst"))
    both = stage(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("__heard"))
        nearer = stage(
            labels.join(heard, labels["node"] == heard["src"]).select(
                "node", F.least("label", "__heard").alias("label"), F.col("label").alias("__old")
            ),
            "heard",
        )
        roots = nearer.select(F.col("node").alias("__root"), F.col("label").alias("__jump"))
        jumped = nearer.join(roots, F.col("label") == F.col("__root")).select(
            "node", F.col("__jump").alias("label"), (F.col("__jump") != F.col("__old")).alias("__moved")
        )
        jumped = stage(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("__moved").isEmpty():
            return labels
