"""Policy sources."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.kinds import ACTIONS, ENTITY_TYPES

SCHEMA = "scope_key string, default_action string, overrides map<string,string>"


def parse_scoped(spec: object, strict_types: bool = False) -> tuple[str | None, dict[str, str]]:
    """Default and overrides of ``{"default"?: …, "overrides"?: {…}}``; wrong shapes fail.

    ``strict_types`` also refuses unknown entity types, as for policies sent with a request.
    """
    if not isinstance(spec, Mapping):
        raise ValueError("a policy must be a JSON object")
    default, overrides = spec.get("default"), spec.get("overrides", {})
    if strict_types and set(spec) - {"default", "overrides"}:
        raise ValueError("a policy has only a default and overrides")
    if "default" in spec and default not in ACTIONS:
        raise ValueError(f"unknown action {default!r}")
    if not isinstance(overrides, Mapping):
        raise ValueError("overrides must be a JSON object")
    for kind, action in overrides.items():
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}")
        if strict_types and kind not in ENTITY_TYPES:
            raise ValueError(f"unknown entity type {kind!r}")
    return default, dict(overrides)


def key_policies(spark: SparkSession, raw: str) -> DataFrame:
    """Key policies from a JSON object ``{key: policy}``. Blank text gives an empty table."""
    rows = []
    if raw.strip():
        try:
            specs = json.loads(raw)
        except json.JSONDecodeError:
            raise ValueError("key policies are not valid JSON") from None
        if not isinstance(specs, Mapping):
            raise ValueError("key policies must be a JSON object")
        for key, spec in specs.items():
            if not key:
                raise ValueError("a policy key must not be empty")
            rows.append((key, *parse_scoped(spec)))
    return spark.createDataFrame(rows, SCHEMA)


def checked_policies(policies: DataFrame) -> DataFrame:
    """A policy table whose actions are verified on the executors: a bad row fails the job."""
    actions = F.concat(
        F.filter(F.array("default_action"), lambda a: a.isNotNull()),
        F.coalesce(F.map_values("overrides"), F.array().cast("array<string>")),
    )
    bad = F.exists(actions, lambda a: ~a.isin(*ACTIONS))
    fault = F.raise_error(F.concat(F.lit("unknown action in policy of "), F.col("scope_key"))).cast("string")
    return policies.withColumn("default_action", F.when(bad, fault).otherwise(F.col("default_action")))


def _shape(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def request_policy(policy_json: str, out: str = "request_policy"):
    """A column ``struct<default,overrides>`` from request JSON. Null text is no policy.

    Any other text must be a JSON object with no fields but ``default`` and ``overrides``, of known
    actions and types; cut JSON, other fields or other shapes fail the job, so a policy meant to block
    is never ignored.
    """
    kind = "struct<default:string,overrides:map<string,string>>"
    given = F.col(policy_json)
    v = F.try_parse_json(given)
    fields = F.when(_shape(v).startswith("OBJECT"), v.cast("map<string,variant>"))
    overrides = F.try_variant_get(v, "$.overrides", "variant")
    entries = F.when(_shape(overrides).startswith("OBJECT"), overrides.cast("map<string,variant>"))

    def known_action(x: Column) -> Column:
        return F.coalesce(F.when(_shape(x) == "STRING", x.cast("string")).isin(*ACTIONS), F.lit(False))

    def absent(name: str) -> Column:
        return ~F.array_contains(F.map_keys(fields), name)

    good = (
        F.forall(F.map_keys(fields), lambda k: k.isin("default", "overrides"))
        & (absent("default") | known_action(F.try_variant_get(v, "$.default", "variant")))
        & (
            absent("overrides")
            | F.coalesce(
                F.forall(F.map_values(entries), known_action)
                & F.forall(F.map_keys(entries), lambda t: t.isin(*ENTITY_TYPES)),
                F.lit(False),
            )
        )
    )
    parsed = F.from_json(given, kind)
    fault = F.raise_error(F.lit("invalid request policy")).cast(kind)
    checked = F.when(F.coalesce(good, F.lit(False)), parsed).otherwise(fault)
    return F.when(given.isNotNull(), checked).alias(out)
