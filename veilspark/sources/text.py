"""Text sources: tables of ``(id…, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions.kinds import MAX_TEXT_CHARS
from veilspark.operators.staging import spread, stage

FORMATS = ("parquet", "json", "text", "orc", "csv")


def read_texts(
    spark: SparkSession, path: str, *ids: str, text: str = "text", format: str = "parquet"
) -> DataFrame:
    """The id columns and the text of a file source or, with format ``table``, of a table.

    Only these columns are read. Inputs too small to keep all cores busy are spread over them. Format
    ``text`` takes each file as one text; :func:`read_lines` takes each line as one.
    """
    if format == "table":
        df = spark.read.table(path)
    elif format == "text":
        df = spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("path"), F.col("value").alias("text")
        )
        ids = ids or ("path",)
    elif format in FORMATS:
        df = spark.read.format(format).load(path)
    else:
        raise ValueError(f"unknown format {format!r}")
    return spread(df.select(*ids, F.col(text).alias("text")), *ids, counted=format in ("parquet", "orc", "table"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, text``: the lines of text files, numbered from 0 in each file.

    Large files are read in blocks by many tasks, as Spark splits them. A block's lines are numbered on
    their own, and blocks get their offsets from the counts of those before them. Lines end at a line
    feed only.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("__block"), F.col("value").alias("text")
    )
    # Written with its order, so that both readers see the same.
    placed = stage(lines.withColumn("__place", F.monotonically_increasing_id()), "lines")
    counts = placed.groupBy("path", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("path", "__block").orderBy("__place")) - 1
    numbered = placed.withColumn("__inside", inside).join(offsets, ["path", "__block"])
    return numbered.select("path", (F.col("__inside") + F.col("__offset")).cast("long").alias("line_no"), "text")


def split_overlong(df: DataFrame, text: str = "text", limit: int = MAX_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Texts up to the limit, and the quarantine of longer or missing ones (without their text)."""
    fits = F.coalesce(F.length(text) <= limit, F.lit(False))
    refused = df.where(~fits).withColumn("n_chars", F.length(text)).withColumn(
        "error", F.when(F.col(text).isNull(), "missing_text").otherwise("text_too_long")
    )
    return df.where(fits), refused.drop(text)
