"""Redaction of several texts under one tokenizer: conversation or whole-table scope.

The same value gets the same placeholder in every text of its scope. Detection runs once and its
outcome is staged; the numbering then reads only the small columns. Texts that need no placeholder
never leave their partition. Token maps come out as vault rows ``(scope, placeholder, value)``,
because the map of a whole table does not fit into a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.hof import built
from veilspark.operators.detect import BUILT_IN, ColumnDetector, Detector, detect
from veilspark.operators.lookup import ROW, attach_values, join_null_safe, numbered_rows
from veilspark.operators.numbering import distinct_values, number_values
from veilspark.operators.policy import LayeredPolicy, Policy
from veilspark.operators.redact import replaced, reported, splice, token_key, tokenized, with_actions
from veilspark.operators.staging import stage


@dataclass(frozen=True)
class Batch:
    """``texts``: ids, other columns, ``redacted, entities, blocked``. ``tokens``: scope columns,
    ``placeholder, value, n``. ``scopes``: scope columns and ``blocked``, for scopes with findings."""

    texts: DataFrame
    tokens: DataFrame
    scopes: DataFrame
    scope: tuple[str, ...]

    def passed(self) -> DataFrame:
        """Texts of scopes where nothing was blocked; one blocked text holds back its whole scope."""
        bad = self.scopes.where("blocked").select(*self.scope)
        return join_null_safe(self.texts, bad, self.scope, "left_anti")

    def passed_tokens(self) -> DataFrame:
        bad = self.scopes.where("blocked").select(*self.scope)
        return join_null_safe(self.tokens, bad, self.scope, "left_anti")


def redact_batch(
    df: DataFrame,
    ids: Sequence[str],
    scope: Sequence[str],
    order: Sequence[str],
    text: str = "text",
    policy: Policy | LayeredPolicy | None = None,
    detectors: Sequence[Detector | ColumnDetector] = BUILT_IN,
    model_spans: Sequence[str] = (),
    unicode_mask: bool = False,
) -> Batch:
    """Redact all texts of a scope under shared numbering.

    ``ids`` name the columns that identify a text for the caller; they may be null or repeat, and every
    row is still redacted on its own. ``scope`` names the columns of its scope (a constant column for
    the whole table) and ``order`` its place in the scope. Rows with a null scope value share a scope.
    """
    missing = [c for c in ids if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    scope, order = list(scope), list(order)
    found = detect(df, text, detectors, "__spans", model_spans)
    acted = with_actions(found, policy or Policy(), "__spans", "__acted").drop("__spans")
    acted = stage(numbered_rows(acted), "batch")

    occurrences = (
        acted.where(F.exists("__acted", tokenized))
        .select(*scope, *order, F.explode(F.filter("__acted", tokenized)).alias("s"))
        .select(*scope, *order, F.col("s.start").alias("__start"), "s.display", "s.value")
    )
    where = [*order, "__start"]
    values = stage(distinct_values(occurrences, scope, where), "values")
    tokens = stage(number_values(values, scope, where), "tokens")

    keyed = acted.withColumn(
        "__keys", F.array_distinct(F.transform(F.filter("__acted", tokenized), token_key))
    )
    table = tokens.withColumn("__key", F.concat("display", F.lit(" "), "value"))
    mapped = attach_values(keyed, "__keys", table, scope, "__key", "placeholder", "__placeholders")
    def pieces() -> Column:
        return replaced(F.col("__acted"), F.map_entries("__placeholders"), unicode_mask)

    texts = (
        mapped.withColumn("__pieces", built(("batch", unicode_mask), pieces))
        .withColumns(
            {
                "redacted": built(("splice", text), lambda: splice(F.col(text), F.col("__pieces"))),
                "entities": built(("reported",), lambda: reported(F.col("__pieces"))),
                "blocked": F.exists("__acted", lambda s: s["action"] == "block"),
            }
        )
        .drop("__pieces", "__placeholders", "__keys", "__acted", ROW, text)
    )
    hits = acted.where(F.size("__acted") > 0)
    scopes = hits.groupBy(*scope).agg(
        F.bool_or(F.exists("__acted", lambda s: s["action"] == "block")).alias("blocked")
    )
    return Batch(texts, tokens.select(*scope, "placeholder", "value", "n"), scopes, tuple(scope))
