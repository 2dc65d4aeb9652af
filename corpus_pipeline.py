"""From documents to shards: toxicity, near duplicates, decontamination, mixing, sharding.

``STAGES`` lists the stages in order. A stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept and returns the rows it keeps, with the columns of ``documents``; the last returns
the shard and the slot of each row. ``run`` writes the outcome of every stage as Parquet in the
shared folder and reads it again for the next one, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.decontaminate import decontaminate
from veilspark.llm.mixing import mix_sources
from veilspark.llm.setjoin import keep_one_each
from veilspark.llm.sharding import shard_rows
from veilspark.llm.toxicity import score_toxicity
from veilspark.operators.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below 0.3. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, threshold=0.3).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by a resemblance of 0.75 of five-word shingles, the smallest id stays."""
    return keep_one_each(docs, percent=75, n=5).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold less than 0.75 of the five-word shingles of every test item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=75)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that expected bytes of a source follow the square root of its bytes."""
    return mix_sources(docs, power=0.5, seed="mix").select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot``: eight shards of near-equal bytes."""
    return shard_rows(docs, ["doc_id", "source"], "text", shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: Learned scores and differencing have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
