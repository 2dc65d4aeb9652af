"""Placeholder labels and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import patterns as p


def normalize_label(label: Column) -> Column:
    """Upper case, anything but A-Z and 0-9 to ``_``, trimmed; ``CUSTOM`` when nothing is left."""
    cleaned = F.btrim(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("CUSTOM"))


def placeholder(display: Column, number: Column) -> Column:
    return F.concat(F.lit("["), display, F.lit("_"), number.cast("string"), F.lit("]"))


def count_placeholders(text: Column) -> Column:
    """Placeholder-shaped literals already in a text; rehydration could not tell them apart."""
    return F.when(F.contains(text, F.lit("[")), F.regexp_count(text, F.lit(p.PLACEHOLDER))).otherwise(F.lit(0))
