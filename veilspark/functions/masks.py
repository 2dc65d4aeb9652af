"""Irreversible masks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALNUM = "[A-Za-z0-9]"
_ANY_ALNUM = r"[\p{L}\p{N}]"


def mask_all(value: Column, unicode_mask: bool = False) -> Column:
    """Hide every letter and digit (ASCII only, unless ``unicode_mask``); keep separators."""
    return F.regexp_replace(value, _ANY_ALNUM if unicode_mask else _ALNUM, "*")


def keep_last(value: Column, n: int, unicode_mask: bool = False) -> Column:
    """Hide all but the last ``n`` letters and digits; keep separators."""
    one, other = (_ANY_ALNUM, r"[^\p{L}\p{N}]") if unicode_mask else (_ALNUM, "[^A-Za-z0-9]")
    return F.regexp_replace(value, rf"{one}(?=(?:{other}*{one}){{{n}}})", "*")


def mask_email(value: Column, unicode_mask: bool = False) -> Column:
    at = F.locate("@", value)
    stars = F.repeat(F.lit("*"), F.greatest(at - 2, F.lit(1)))
    partial = F.concat(F.substring(value, 1, 1), stars, F.substring(value, at, F.length(value)))
    return F.when(at <= 1, mask_all(value, unicode_mask)).otherwise(partial)


def mask_value(kind: Column, value: Column, unicode_mask: bool = False) -> Column:
    """The masked form of a value of an entity type."""
    alnum = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]" if unicode_mask else "[^A-Za-z0-9]", ""))
    return (
        F.when(
            kind.isin("CREDIT_CARD", "PHONE", "SSN", "IPV4", "IPV6", "JWT", "API_KEY"),
            keep_last(value, 4, unicode_mask),
        )
        .when(kind == "EMAIL", mask_email(value, unicode_mask))
        .when(kind.isin("DATE", "ADDRESS", "NAME"), mask_all(value, unicode_mask))
        .when(alnum > 4, keep_last(value, 2, unicode_mask))
        .otherwise(mask_all(value, unicode_mask))
    )
