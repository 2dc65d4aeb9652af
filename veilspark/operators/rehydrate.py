"""Rehydration: put the original values back in place of placeholders.

One scan over the text: a token the map knows is replaced, any other stays, and restored values are
never scanned again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as p
from veilspark.functions.hof import let, lookup_all


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(p.PLACEHOLDER), F.lit(0))


def rehydrate(text: Column, token_map: Column, json_escape: bool = False) -> Column:
    """The text with every known placeholder restored. A null map restores nothing.

    ``json_escape`` escapes the values for use inside a JSON string literal.
    """

    def restore(token: Column, value: Column) -> Column:
        if json_escape:
            quoted = F.to_json(F.array(value))
            value = F.when(value.isNotNull(), F.substring(quoted, F.lit(3), F.length(quoted) - 4))
        return F.coalesce(value, token)

    restored = let(
        tokens_in(text), lambda tokens: F.zip_with(tokens, lookup_all(tokens, F.map_entries(token_map)), restore)
    )
    pieces = F.zip_with(
        F.split(text, p.PLACEHOLDER, -1), restored, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))
    )
    return F.when(
        F.contains(text, F.lit("[")) & (F.coalesce(F.size(token_map), F.lit(0)) > 0), F.array_join(pieces, "")
    ).otherwise(text)
