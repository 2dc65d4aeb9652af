"""Redaction at document scope: spans in, redacted text, entities, token map and block flag out.

Overlaps are resolved before the policy is asked, so an allowed longer span shields what lies inside
it. Everything happens inside the row: no shuffle, and one projection per step so that no step is
evaluated twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.hof import BLOCK, built, let, lookup_all, once
from veilspark.functions.labels import count_placeholders, normalize_label, placeholder
from veilspark.functions.masks import mask_value
from veilspark.operators.detect import BUILT_IN, ColumnDetector, Detector, detect
from veilspark.operators.overlaps import resolve_overlaps
from veilspark.operators.policy import LayeredPolicy, Policy

def with_actions(
    df: DataFrame, policy: Policy | LayeredPolicy, spans: str = "spans", out: str = "acted"
) -> DataFrame:
    """Resolve overlaps, then give every kept span its label, display label and action."""
    def act(s: Column) -> Column:
        return F.struct(
            s["type"].alias("type"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            F.coalesce(s["label"], s["type"]).alias("label"),
            F.when(s["label"].isNull(), s["type"]).otherwise(normalize_label(s["label"])).alias("display"),
            policy.action(s["type"]).alias("action"),
        )

    key = ("acted", spans, *policy.key_of())
    return once(df, out, built(key, lambda: F.transform(resolve_overlaps(F.col(spans)), act)))


def tokenized(span: Column) -> Column:
    return span["action"].isin("redact", "block")


def token_key(span: Column) -> Column:
    """Equal keys share one placeholder. Displays hold no blank, so the key is unambiguous."""
    return F.concat(span["display"], F.lit(" "), span["value"])


def number_in_row(acted: Column) -> Column:
    """``array<struct<key,placeholder,value>>``: per display label, 1, 2, 3… by first occurrence."""
    keys = F.array_distinct(F.transform(F.filter(acted, tokenized), token_key))

    def by_display(ks: Column) -> Column:
        displays = F.array_distinct(F.transform(ks, lambda k: F.substring_index(k, " ", 1)))
        return F.flatten(
            F.transform(
                displays,
                lambda d: F.transform(
                    F.filter(ks, lambda k: F.startswith(k, F.concat(d, F.lit(" ")))),
                    lambda k, i: F.struct(
                        k.alias("key"),
                        placeholder(d, i + 1).alias("placeholder"),
                        F.substring(k, F.length(d) + 2, F.length(k)).alias("value"),
                    ),
                ),
            )
        )

    return let(keys, by_display)


def splice(text: Column, pieces: Column) -> Column:
    """Rebuild a text from ``array<struct<start,end,new>>`` of disjoint, sorted replacements.

    The text is cut once per block of pieces and then within the block, so that many pieces in a
    long text do not each walk the text from its start.
    """

    def block_text(i: Column) -> Column:
        lo = F.when(i == 1, F.lit(0)).otherwise(F.coalesce(F.try_element_at(pieces, i - 1)["end"], F.lit(0)))

        def parts(block: Column) -> Column:
            chunk = F.substring(text, lo + 1, F.element_at(block, -1)["end"] - lo)
            return let(
                chunk,
                lambda c: F.array_join(
                    F.transform(
                        block,
                        lambda x, j: F.concat(
                            let(
                                F.when(j == 0, lo).otherwise(F.get(block, j - 1)["end"]),
                                lambda prev: F.substring(c, prev - lo + 1, x["start"] - prev),
                            ),
                            x["new"],
                        ),
                    ),
                    "",
                ),
            )

        return let(F.slice(pieces, i, F.lit(BLOCK)), parts)

    starts = F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK))
    tail = F.substring(text, F.element_at(pieces, -1)["end"] + 1, F.length(text))
    rebuilt = F.concat(F.array_join(F.transform(starts, block_text), ""), tail)
    return F.when(F.size(pieces) > 0, rebuilt).otherwise(text)


def replaced(acted: Column, placeholders: Column, unicode_mask: bool = False) -> Column:
    """Spans that change or are reported, with their replacement text in ``new``.

    ``placeholders`` is ``array<struct<key,value>>``. All spans are looked up together; a token
    without a placeholder fails the job rather than losing text.
    """
    missing = F.raise_error(F.lit("no placeholder for a finding")).cast("string")

    def with_new(spans: Column, found: Column) -> Column:
        return F.transform(
            spans,
            lambda s, i: F.struct(
                s["type"].alias("type"),
                s["label"].alias("label"),
                s["action"].alias("action"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.when(s["action"] == "mask", mask_value(s["type"], s["value"], unicode_mask))
                .otherwise(F.coalesce(F.get(found, i), missing))
                .alias("new"),
            ),
        )

    def looked_up(spans: Column) -> Column:
        keys = F.transform(spans, lambda s: F.when(tokenized(s), token_key(s)))
        return let(lookup_all(keys, placeholders), lambda found: with_new(spans, found))

    return let(F.filter(acted, lambda s: s["action"] != "allow"), looked_up)


def reported(pieces: Column) -> Column:
    """Entities for callers: no raw value."""
    return F.transform(
        pieces,
        lambda s: F.struct(
            s["type"].alias("type"),
            s["label"].alias("label"),
            s["new"].alias("placeholder"),
            s["action"].alias("action"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        ),
    )


def wire_entities(entities: Column) -> Column:
    """Entities without offsets, as sent to a caller."""
    return F.transform(
        entities,
        lambda e: F.struct(
            e["type"].alias("type"),
            e["label"].alias("label"),
            e["placeholder"].alias("placeholder"),
            e["action"].alias("action"),
        ),
    )


def _own_pieces(acted: str, unicode_mask: bool) -> Column:
    entries = F.transform("__tokens", lambda t: F.struct(t["key"].alias("key"), t["placeholder"].alias("value")))
    return replaced(F.col(acted), entries, unicode_mask)


def apply_actions(df: DataFrame, text: str = "text", acted: str = "acted", unicode_mask: bool = False) -> DataFrame:
    """Replace ``text`` and ``acted`` by ``redacted, entities, token_map, blocked``."""
    numbered = once(df, "__tokens", built(("tokens", acted), lambda: number_in_row(F.col(acted))))
    pieces = once(numbered, "__pieces", built(("pieces", acted, unicode_mask), lambda: _own_pieces(acted, unicode_mask)))
    return (
        pieces.withColumn(
            "token_map", F.map_from_entries(F.transform("__tokens", lambda t: F.struct(t["placeholder"], t["value"])))
        )
        .withColumns(
            {
                "redacted": built(("splice", text), lambda: splice(F.col(text), F.col("__pieces"))),
                "entities": built(("reported",), lambda: reported(F.col("__pieces"))),
                "blocked": F.exists(acted, lambda s: s["action"] == "block"),
            }
        )
        .drop("__tokens", "__pieces", acted, text)
    )


def redact(
    df: DataFrame,
    text: str = "text",
    policy: Policy | LayeredPolicy | None = None,
    detectors: Sequence[Detector | ColumnDetector] = BUILT_IN,
    model_spans: Sequence[str] = (),
    unicode_mask: bool = False,
    warn_placeholders: bool = False,
) -> DataFrame:
    """Redact every row's text on its own. Adds ``redacted, entities, token_map, blocked``.

    ``model_spans`` names columns of model-made spans to merge with the detectors' own. With
    ``warn_placeholders`` a ``preexisting_placeholders`` count is added.
    """
    found = detect(df, text, detectors, "__spans", model_spans)
    if warn_placeholders:
        found = found.withColumn("preexisting_placeholders", count_placeholders(F.col(text)))
    acted = with_actions(found, policy or Policy(), "__spans", "__acted").drop("__spans")
    return apply_actions(acted, text, "__acted", unicode_mask)


def split_blocked(redacted: DataFrame, *ids: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the quarantine of blocked rows: ids and wire entities, no text, no map."""
    passed = redacted.where(~F.col("blocked"))
    quarantine = redacted.where("blocked").select(
        *ids, F.lit("blocked").alias("error"), wire_entities(F.col("entities")).alias("entities")
    )
    return passed, quarantine
