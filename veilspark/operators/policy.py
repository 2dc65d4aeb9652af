"""Policies: which action applies to an entity type.

Order of precedence: request override, request default, key override, key default, server override,
server default. A layer that says nothing is skipped, and a higher layer's *default* beats a lower
layer's *override*.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.kinds import ACTIONS, ENTITY_TYPES
from veilspark.operators.lookup import hot_threshold
from veilspark.operators.staging import stage


def check_action(action: str) -> str:
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}; expected one of {', '.join(ACTIONS)}")
    return action


@dataclass(frozen=True)
class Policy:
    """The server's policy. Immutable; actions are checked when it is made."""

    default: str = "redact"
    overrides: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_action(self.default)
        for action in self.overrides.values():
            check_action(action)

    @classmethod
    def from_function(cls, resolve: Callable[[str], str]) -> Policy:
        """Tabulate a type-to-action function over all entity types."""
        return cls("redact", {t: resolve(t) for t in ENTITY_TYPES})

    def action(self, kind: Column) -> Column:
        chosen = F.lit(self.default)
        by_action: dict[str, list[str]] = {}
        for t, a in self.overrides.items():
            by_action.setdefault(a, []).append(t)
        for a, kinds in by_action.items():
            chosen = F.when(kind.isin(*kinds), a).otherwise(chosen)
        return chosen

    def key_of(self) -> tuple:
        """What the policy's expression depends on."""
        return (self.default, *sorted(self.overrides.items()))


@dataclass(frozen=True)
class LayeredPolicy:
    """A server policy under optional per-row layers held in columns.

    ``request`` and ``key`` name struct columns ``struct<default:string, overrides:map<..>>``; a
    null struct, default or map entry is an absent layer.
    """

    server: Policy = field(default_factory=Policy)
    request: str | None = None
    key: str | None = None

    def action(self, kind: Column) -> Column:
        layers: list[Column] = []
        for name in (self.request, self.key):
            if name:
                layer = F.col(name)
                layers += [F.try_element_at(layer["overrides"], kind), layer["default"]]
        return F.coalesce(*layers, self.server.action(kind))

    def key_of(self) -> tuple:
        return (self.request, self.key, self.server.key_of())


SCOPED = "struct<default:string,overrides:map<string,string>>"


def with_key_policy(
    df: DataFrame,
    policies: DataFrame,
    key: str,
    out: str = "key_policy",
    max_rows: int = 100_000,
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """Attach each row's key policy: ``policies`` holds ``(scope_key, default_action, overrides)``.

    Policy tables hold one row per tenant. Up to ``max_rows`` and ``max_bytes`` they are broadcast, which
    also keeps a tenant with most of the rows from landing in one task. Of a larger table only the
    policies of such tenants are broadcast, and the others are joined by shuffle; for that the keys of
    ``df`` are counted first, with ``df`` read once more. Rows without a key or a policy get null.
    """
    scoped = policies.select(
        F.col("scope_key").alias("__key"),
        F.struct(F.col("default_action").alias("default"), F.col("overrides").alias("overrides")).alias(out),
    )
    spelled = F.octet_length("__key") + F.octet_length(F.to_json(out))
    rows, size = scoped.agg(F.count("*"), F.sum(spelled)).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return df.join(F.broadcast(scoped), df[key] == F.col("__key"), "left").drop("__key")
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    used = stage(counts.join(scoped, "__key", "left"), "policies")
    limit = hot_threshold(used.agg(F.sum("__n")).first()[0] or 0)
    hot = used.where(F.col("__n") >= limit).select("__key", out)  # at most HOT_KEYS, with or without a policy
    cold = used.where(F.col("__n") < limit).select("__key", out)
    marked = df.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), df[key] == F.col("__key"), "left")
    settled = F.coalesce("__hot", F.col(key).isNull())
    done = marked.where(settled).drop("__key", "__hot")
    rest = marked.where(~settled).drop("__key", "__hot", out)
    return done.unionByName(rest.join(cold, rest[key] == F.col("__key"), "left").drop("__key"))
