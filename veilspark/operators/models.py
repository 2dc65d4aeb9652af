"""Spans made by models: as a table joined by document, or by a plug-in run over batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.hof import empty
from veilspark.functions.kinds import ENTITY_TYPES, SPANS
from veilspark.operators.detect import MODEL_RANK, cut_spans
from veilspark.operators.lookup import join_hot, join_null_safe
from veilspark.operators.staging import stage

OFFSETS = "array<struct<start:int,end:int,type:string>>"


def parse_spans(reply: Column, kind: str = "NAME") -> Column:
    """Spans from a service's JSON reply: ``{"spans": [...]}`` or a bare array; null when unusable.

    Offsets may be any JSON numbers and are cut to integers; entries without are dropped. The caller
    fixes the entity type.
    """
    v = F.try_parse_json(reply)
    shape = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    listed = F.when(shape.startswith("ARRAY"), v).when(
        shape.startswith("OBJECT"), F.try_variant_get(v, "$.spans", "variant")
    )
    numbers = F.transform(
        F.when(F.schema_of_variant(listed).startswith("ARRAY"), listed.cast("array<variant>")),
        lambda s: F.struct(
            *(
                F.when(
                    F.schema_of_variant(F.try_variant_get(s, f"$.{n}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)"),
                    F.try_variant_get(s, f"$.{n}", "double").cast("int"),
                ).alias(n)
                for n in ("start", "end")
            ),
            F.lit(kind).alias("type"),
        ),
    )
    none = F.when(shape.startswith("OBJECT"), empty(OFFSETS))
    return F.coalesce(numbers, none)


def join_model_spans(
    texts: DataFrame,
    spans: DataFrame,
    ids: Sequence[str],
    text: str = "text",
    kind: str | None = None,
    out: str = "model_spans",
    rank: int = MODEL_RANK,
) -> DataFrame:
    """Left-join a spans table ``(ids, start, end[, type])`` and add the usable spans as ``out``.

    A type outside the known ones fails the job; name ``kind`` to map all of them to one. Spans are
    grouped per text first, so the join cannot be skewed by spans; adaptive execution broadcasts a small
    span side instead of shuffling the texts. Null ids match themselves, and texts that share an id
    share its spans; an id that many texts share, null as well, goes through a broadcast.
    """
    ids = list(ids)
    typed = spans if "type" in spans.columns else spans.withColumn("type", F.lit(kind or "NAME"))
    if kind:
        typed = typed.withColumn("type", F.lit(kind))
    unknown = F.raise_error(F.concat(F.lit("unknown entity type "), F.coalesce("type", F.lit("null")))).cast("string")
    known = typed.withColumn("type", F.when(F.col("type").isin(*ENTITY_TYPES), F.col("type")).otherwise(unknown))
    grouped = known.groupBy(*ids).agg(
        F.sort_array(
            F.collect_set(
                F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type")
            )
        ).alias("__offsets")
    )
    if texts.isStreaming:
        joined = join_null_safe(texts, grouped, ids, "left")
    else:
        # Every id of a text, also one without spans, so that a frequent one is known as such.
        counts = texts.groupBy(*ids).agg(F.count("*").alias("__n"))
        joined = join_hot(texts, stage(join_null_safe(counts, grouped, ids, "left"), "model_spans"), ids, "__n")
    cut = cut_spans(F.col("__offsets"), F.col(text), None, None, rank)
    return joined.withColumn(out, F.coalesce(cut, empty(SPANS))).drop("__offsets")


def detect_with_model(
    texts: DataFrame,
    load: Callable[[], Callable[[list[str]], list[list[tuple[int, int]]]]],
    kind: str = "NAME",
    text: str = "text",
    on_error: str = "empty",
    out: str = "model_spans",
    rank: int = MODEL_RANK,
) -> DataFrame:
    """Add ``out``: spans from a model run over Arrow batches of texts.

    ``load()`` runs once per task and returns ``predict(texts) -> [[(start, end), …], …]``. A batch
    that fails gives no spans (``on_error="empty"``, the default) or fails the job (``"throw"``).
    """
    if on_error not in ("empty", "throw"):
        raise ValueError("on_error must be 'empty' or 'throw'")
    if kind not in ENTITY_TYPES:
        raise ValueError(f"unknown entity type {kind!r}")
    schema = T.StructType(
        [*texts.schema.fields, T.StructField("__offsets", T.ArrayType(T.StructType(
            [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
        )))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for batch in batches:
            try:
                if predict is None:
                    predict = load()
                spans = predict(batch[text].tolist())
                if len(spans) != len(batch):
                    raise ValueError("model returned a result of the wrong length")
                rows = [[{"start": int(s), "end": int(e)} for s, e in one] for one in spans]
            except Exception:
                if on_error == "throw":
                    # The cause may quote the text, so it is not chained.
                    raise RuntimeError("model detection failed") from None
                rows = [[] for _ in range(len(batch))]
            yield batch.assign(__offsets=pd.Series(rows, index=batch.index, dtype=object))

    ran = texts.mapInPandas(run, schema)
    cut = cut_spans(F.col("__offsets"), F.col(text), kind, None, rank)
    return ran.withColumn(out, F.coalesce(cut, empty(SPANS))).drop("__offsets")
