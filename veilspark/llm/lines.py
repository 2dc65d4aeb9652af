"""Line deduplication: normalised lines are grouped by digest over the whole corpus, the earliest stays.

A line keeps its byte offsets in the original text from the moment it is cut. Digests are folded by
partial aggregation to their earliest place, so a line that stands in a third of all documents is a
single row before anything is shuffled by its digest; lines that occur once never travel again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.lookup import join_hot
from veilspark.operators.staging import stage

def cut_units(text: str, separator: bytes, least: int, runs: bool) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each line of at least ``least`` normalised bytes. ``end`` is behind the separator.

    Normalised: A-Z as a-z, runs of blanks and control characters from tab to carriage return as one
    blank, none at either end. With ``runs``, lines between blank ones also are one unit together, so
    that a passage is the same unit however it is wrapped.
    """
    raw, start = text.encode("utf-8", "replace"), 0
    run: list[bytes] = []
    run_start = run_end = 0
    while start < len(raw):
        at = raw.find(separator, start)
        stop, end = (len(raw), len(raw)) if at < 0 else (at, at + len(separator))
        plain = b" ".join(raw[start:stop].lower().split())
        if plain and len(plain) >= least:
            yield start, end, xxhash.xxh3_128_digest(plain)
        if runs and plain:
            run_start, run_end = run_start if run else start, end
            run.append(plain)
        if run and (not plain or end == len(raw)):
            if len(run) > 1 and sum(map(len, run)) + len(run) - 1 >= least:
                yield run_start, run_end, xxhash.xxh3_128_digest(b" ".join(run))
            run = []
        start = end


def _units(separator: bytes, least: int, runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for k, text in enumerate(batch.column("__text")):
                for unit in cut_units(text.as_py() or "", separator, least, runs):
                    for column, value in zip(rows, (k, *unit), strict=True):
                        column.append(value)
            at = pa.array(rows[0], pa.int64())
            yield pa.record_batch(
                [batch.column("__id").take(at), batch.column("__th").take(at), pa.array(rows[1], pa.int64()),
                 pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())],
                names=["id", "th", "start", "end", "digest"],
            )

    return run


def _key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated_units(
    docs: DataFrame, doc_id: str, text: str, separator: bytes = b"\n", least: int = 1, runs: bool = False
) -> tuple[DataFrame, DataFrame]:
    """All units, and of them those to remove: ``id, th, start, end, digest``."""
    source = docs.select(
        F.col(doc_id).alias("__id"), _key(text).alias("__th"), F.coalesce(F.col(text), F.lit("")).alias("__text")
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    units = stage(
        source.mapInArrow(_units(separator, least, runs), f"id {kind}, th long, start long, end long, digest binary"), "units"
    )
    # Null ids come last. Rows that repeat id and text have one rank.
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "th", "start")
    folded = units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n"))
    several = stage(folded.where(F.col("first") != F.col("last")).select("digest", "first", "n"), "repeated")
    found = join_hot(units, several, ["digest"], "n")
    return units, found.where(rank != F.col("first")).select("id", "th", "start", "end", "digest")


def _joined(spans_of: pa.Array) -> pa.Array:
    """Sorted spans with those that touch or overlap joined."""
    out = []
    for spans in spans_of:
        joined: list[dict] = []
        for span in spans.as_py() or ():
            if joined and span["start"] <= joined[-1]["end"]:
                joined[-1]["end"] = max(joined[-1]["end"], span["end"])
            else:
                joined.append(dict(span))
        out.append(joined)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    separator: str = "\n",
    least: int = 1,
    runs: bool = False,
) -> DataFrame:
    """Add ``removed``, the maximal removed byte spans in the original text in order, ``n_units``,
    ``n_removed`` (units found earlier) and ``kept``.

    Lines rank by document id, then by place; of equal normalised lines the first stays, also within
    a document. ``separator`` may be two newlines for paragraphs. A line is removed with its separator.
    With ``runs``, several lines between blank ones are a unit as well, equal to a single line or other
    lines of the same words. Lines below ``least`` normalised bytes are no units; by default all are
    but blank ones.
    Null, empty and blank texts have no lines; ``kept`` of null is the empty text. Null ids rank last.
    Rows that repeat id and text are one document and get equal results. Columns of ``docs`` with the
    new names are replaced, others are kept.
    """
    sep = separator.encode()
    maximal = F.arrow_udf(_joined, "array<struct<start:bigint,end:bigint>>")
    docs = docs.drop("removed", "n_units", "n_removed", "kept")
    units, gone = repeated_units(docs, doc_id, text, sep, least, runs)
    counted = units.distinct().groupBy("id", "th").agg(F.count("*").alias("n_units"))
    spans = gone.distinct().groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    spans = spans.select("id", "th", F.size("__spans").cast("long").alias("n_removed"), maximal("__spans").alias("removed"))
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.th") == F.col("r.th"))
    known = stage(
        counted.alias("l").join(spans.alias("r"), same, "left").select(
            F.col("l.id").alias("__id"), F.col("l.th").alias("__th"), "n_units", "n_removed", "removed"
        ),
        "spans",
    )

    @F.arrow_udf("string")
    def rest(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for t, spans_of in zip(texts, removed, strict=True):
            raw, at, parts = (t.as_py() or "").encode("utf-8", "replace"), 0, []
            for span in spans_of.as_py() or ():
                parts.append(raw[at : span["start"]])
                at = span["end"]
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pa.array(out, pa.string())

    joined = docs.join(known, F.col(doc_id).eqNullSafe(F.col("__id")) & (_key(text) == F.col("__th")), "left")
    full = joined.withColumns(
        {
            "n_units": F.coalesce("n_units", F.lit(0)),
            "n_removed": F.coalesce("n_removed", F.lit(0)).cast("long"),
            "removed": F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")),
        }
    ).drop("__id", "__th")
    plain = F.coalesce(F.col(text), F.lit(""))
    return full.withColumn("kept", F.when(F.size("removed") > 0, rest(plain, F.col("removed"))).otherwise(plain))
