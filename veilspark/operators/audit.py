"""Audit rows and counters. Raw values and placeholders never reach either."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.hof import let


def entity_counts(entities: Column) -> Column:
    """Count per entity type as a map, from a row's reported entities."""
    return let(
        F.transform(entities, lambda e: e["type"]),
        lambda types: F.map_from_entries(
            F.transform(
                F.array_sort(F.array_distinct(types)),
                lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)).cast("long")),
            )
        ),
    )


def audit_events(
    redacted: DataFrame, request_id: str | Column, route: str | Column, ts: Column
) -> DataFrame:
    """One row per redaction request, blocked ones included: ``ts, request_id, route, blocked,
    entity_counts, total_entities``. The time is given by the caller, so a rerun writes the same."""
    rid = F.col(request_id) if isinstance(request_id, str) else request_id
    way = F.lit(route) if isinstance(route, str) else route
    return redacted.select(
        ts.alias("ts"),
        rid.cast("string").alias("request_id"),
        way.alias("route"),
        F.col("blocked"),
        entity_counts(F.col("entities")).alias("entity_counts"),
        F.size("entities").cast("long").alias("total_entities"),
    )


def audit_scopes(
    texts: DataFrame, scope: Sequence[str], request_id: Column, route: str, ts: Column
) -> DataFrame:
    """One audit row per scope of a batch. Counts are summed per type before any row is grouped, so
    a scope with most of the texts reaches its group as at most one row per type and task."""
    typed = texts.select(
        *scope,
        "blocked",
        F.explode_outer(F.transform("entities", lambda e: e["type"])).alias("type"),
    )
    per_type = typed.groupBy(*scope, "type").agg(
        F.count("type").alias("c"), F.bool_or("blocked").alias("blocked")
    )
    counted = F.filter(F.collect_list(F.struct("type", "c")), lambda x: x["type"].isNotNull())
    return per_type.groupBy(*scope).agg(
        F.bool_or("blocked").alias("blocked"),
        F.map_from_entries(F.sort_array(counted)).alias("entity_counts"),
        F.sum("c").alias("total_entities"),
    ).select(
        ts.alias("ts"),
        request_id.cast("string").alias("request_id"),
        F.lit(route).alias("route"),
        "blocked",
        "entity_counts",
        "total_entities",
    )


def write_audit(events: DataFrame, kind: str, path: str | None = None) -> None:
    """Append audit rows to a sink: ``none``, ``stdout`` or ``file`` (JSON lines under ``path``)."""
    if kind == "none":
        return
    if kind == "stdout":
        events.write.format("console").option("truncate", False).mode("append").save()
    elif kind == "file" and path:
        events.write.mode("append").json(path)
    else:
        raise ValueError(f"unknown audit sink {kind!r}, or no path for a file sink")


def requests_total(events: DataFrame) -> DataFrame:
    return events.groupBy("route").agg(F.count("*").alias("requests_total"))


def entities_total(redacted: DataFrame) -> DataFrame:
    """Reported entities by type and action."""
    kinds = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["action"].alias("action")))
    return (
        redacted.select(F.explode(kinds).alias("e"))
        .groupBy("e.type", "e.action")
        .agg(F.count("*").alias("entities_total"))
    )


def blocked_total(events: DataFrame) -> DataFrame:
    return events.where("blocked").groupBy("route").agg(F.count("*").alias("blocked_total"))


def rate_limited_total(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("allowed")).groupBy("route").agg(F.count("*").alias("rate_limited_total"))
