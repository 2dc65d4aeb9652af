"""Words and word shingles as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.hof import once

#: White space that parts words: blank and the control characters from tab to carriage return.
SPACES = r"[\x09-\x0D\x20]+"
N = 5


def words(text: Column) -> Column:
    """Words of a text in lower case; none for null and blank texts."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), "")


def _over(items: str, make, n: int) -> Column:
    """``make`` over every run of ``n`` items; over all of them if there are fewer, nothing for none."""
    size = F.size(items)
    runs = F.transform(F.sequence(F.lit(0), size - n), lambda i: make([F.get(items, i + k) for k in range(n)]))
    short = [F.when(size == m, F.array(make([F.get(items, F.lit(k)) for k in range(m)]))) for m in range(1, n)]
    return F.when(size >= n, runs).otherwise(F.coalesce(*short, F.array().cast(runs_type(make))))


def runs_type(make) -> str:
    return "array<bigint>" if make is hashed else "array<string>"


def hashed(run: list[Column]) -> Column:
    return F.xxhash64(*run)


def spelled(run: list[Column]) -> Column:
    return F.concat_ws(" ", *run)


def with_shingle_hashes(df: DataFrame, text: str, out: str, n: int = N) -> DataFrame:
    """Add the 64-bit hashes of all shingles, in order, repeats included."""
    hashes = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    counted = once(df, "__words", hashes)
    return counted.withColumn(out, _over("__words", hashed, n)).drop("__words")


def with_shingles(df: DataFrame, text: str, out: str, n: int = N) -> DataFrame:
    """Add all shingles as texts, words joined by one blank, in order, repeats included."""
    return once(df, "__words", words(F.col(text))).withColumn(out, _over("__words", spelled, n)).drop("__words")
