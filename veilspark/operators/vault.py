"""The token vault: maps from placeholder to value under an opaque id, with an expiry.

The vault is a table partitioned by expiry date, so expired days are pruned without being read. Two
shapes: one row per map (``map_id, scope_id, entries, created_at, expires_at``) for document or
request scope, and one row per token (``map_id, placeholder, value``) where a map can outgrow a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.kinds import TOKEN_MAP, VAULT_MAX_ENTRIES, VAULT_TTL_MS
from veilspark.operators.lookup import ROW, attach_values, numbered_rows
from veilspark.operators.numbering import with_rank
from veilspark.operators.rehydrate import rehydrate, tokens_in
from veilspark.operators.staging import delete_folder, numbered_folders, stage

VAULT = (
    "map_id string, scope_id string, entries map<string,string>, created_at timestamp, "
    "expires_at timestamp, expires_date date"
)

#: Folders of a swept vault.
GENERATION = "generation-"


def map_id(run_id: str, scope_id: Column, secret: str = "") -> Column:
    """An opaque id that is the same when a task is run again.

    With a ``secret`` it can not be guessed from the run and the scope: the secret is hashed in twice,
    around an inner digest.
    """
    plain = F.sha2(F.concat_ws("\x1f", F.lit(run_id), scope_id.cast("string")), 256)
    if not secret:
        return plain
    inner = F.sha2(F.concat_ws("\x1f", F.lit(secret), plain), 256)
    return F.sha2(F.concat_ws("\x1f", F.lit(secret), inner), 256)


def utc_day(moment: Column) -> Column:
    """The day in UTC, whatever the session's time zone."""
    days = F.floor(F.unix_micros(moment.cast("timestamp")) / F.lit(86_400_000_000))
    return F.date_from_unix_date(days.cast("int"))


def later(moment: Column, ms: int) -> Column:
    return F.timestamp_micros(F.unix_micros(moment.cast("timestamp")) + F.lit(ms * 1000).cast("long"))


def to_vault(
    redacted: DataFrame,
    scope_id: str,
    run_id: str,
    created_at: Column,
    ttl_ms: int = VAULT_TTL_MS,
    token_map: str = "token_map",
    secret: str = "",
) -> DataFrame:
    """Vault rows for redacted rows. Blocked rows store nothing. A ``secret`` makes ids unguessable."""
    made = created_at.cast("timestamp")
    return redacted.where(~F.col("blocked")).select(
        map_id(run_id, F.col(scope_id), secret).alias("map_id"),
        F.col(scope_id).cast("string").alias("scope_id"),
        F.col(token_map).alias("entries"),
        made.alias("created_at"),
        later(made, ttl_ms).alias("expires_at"),
        utc_day(later(made, ttl_ms)).alias("expires_date"),
    )


def to_token_vault(
    tokens: DataFrame,
    scope: Sequence[str],
    run_id: str,
    created_at: Column,
    ttl_ms: int = VAULT_TTL_MS,
    secret: str = "",
) -> DataFrame:
    """Vault rows ``map_id, scope…, placeholder, value`` with times, from the token rows of a batch.

    For scopes whose map can outgrow a row. ``map_id`` is one per scope.
    """
    made = created_at.cast("timestamp")
    key = F.to_json(F.struct(*scope), {"ignoreNullFields": "false"})
    return tokens.select(
        map_id(run_id, key, secret).alias("map_id"),
        *scope,
        "placeholder",
        "value",
        made.alias("created_at"),
        later(made, ttl_ms).alias("expires_at"),
        utc_day(later(made, ttl_ms)).alias("expires_date"),
    )


def live_tokens(vault: DataFrame, now: Column, scope: Sequence[str]) -> DataFrame:
    """``scope…, placeholder, value`` of the token rows that have not expired; rewritten rows count once."""
    return live(vault, now).groupBy(*scope, "placeholder").agg(F.max_by("value", "expires_at").alias("value"))


def write_vault(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("expires_date").parquet(path)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VAULT).parquet(path)


def live(vault: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired: ``expires_at > now``. Prunes whole days where it can."""
    current = vault.where(F.col("expires_at") > now)
    if "expires_date" in vault.columns:
        current = current.where(F.col("expires_date") >= utc_day(now))
    return current


def vault_size(vault: DataFrame, now: Column) -> DataFrame:
    return live(vault, now).agg(F.count("*").alias("size"))


def evict(vault: DataFrame, max_entries: int = VAULT_MAX_ENTRIES) -> DataFrame:
    """The newest ``max_entries`` maps; the oldest give way. A top-k, not a global sort."""
    return vault.orderBy(F.col("created_at").desc(), F.col("map_id").desc()).limit(max_entries)


def lifetimes(vault: DataFrame, max_entries: int = VAULT_MAX_ENTRIES) -> DataFrame:
    """Unique maps with ``ends_at``: the time from which a vault of ``max_entries`` has them no more.

    A store makes room by dropping the oldest map, so a map goes when it expires or when the
    ``max_entries``-th map after it is stored, whichever is first. Maps are stored in the order of
    ``created_at``, then ``map_id``. All maps live equally long, as in a vault with one lifetime;
    otherwise a map that outlives later ones could be kept longer than is said here. Rows written again
    count once, from their first time.
    """
    others = [c for c in vault.columns if c not in ("map_id", "created_at", "expires_at")]
    stored = vault.groupBy("map_id").agg(
        F.min("created_at").alias("created_at"),
        F.min_by("expires_at", "created_at").alias("expires_at"),
        *(F.min_by(c, "created_at").alias(c) for c in others),
    )
    ranked = stage(with_rank(stored, ("created_at", "map_id"), "__rank"), "stored")
    later_stored = ranked.select(
        (F.col("__rank") - max_entries).alias("__rank"), F.col("created_at").alias("__evicted")
    ).where("__rank > 0")
    joined = ranked.join(later_stored, "__rank", "left")
    return joined.withColumn("ends_at", F.least("expires_at", "__evicted")).drop("__rank", "__evicted")


def lookup_as_of(
    texts: DataFrame, vault: DataFrame, at: str, max_entries: int = VAULT_MAX_ENTRIES, map_id: str = "map_id"
) -> DataFrame:
    """Texts with the ``token_map`` that a bounded vault gives at their own time ``at``; null for a miss.

    A map answers from ``created_at`` up to, and not at, the end of its lifetime.
    """
    known = lifetimes(vault.select("map_id", "entries", "created_at", "expires_at"), max_entries).select(
        F.col("map_id").alias("__id"), F.col("entries").alias("__entries"), F.col("created_at").alias("__from"),
        F.col("ends_at").alias("__to"),
    )
    there = (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__to"))
    joined = texts.join(known, texts[map_id] == known["__id"], "left")
    return joined.withColumn("token_map", F.when(there, F.col("__entries"))).drop("__id", "__entries", "__from", "__to")


def swept_path(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest complete generation of a swept vault: what readers read and writers append to."""
    complete = [n for n, done in numbered_folders(spark, path, GENERATION) if done]
    return f"{path}/{GENERATION}{complete[-1]}" if complete else None


def sweep_vault(spark: SparkSession, rows: DataFrame, path: str, now: Column, keys: Sequence[str] = ("map_id",)) -> str:
    """Write the live rows, each key once by its latest expiry, as the next generation; its folder.

    A generation counts when its job has committed, which Spark marks by a file. Readers of
    :func:`swept_path` see the old table until then and the new one afterwards. A sweep that was killed
    leaves an unmarked generation, which the next sweep writes over, so running it again gives the same
    table. The generation before stays for readers that have begun; older ones are deleted. Only one
    sweep may run, and rows appended while it runs belong to the old generation.
    """
    complete = [n for n, done in numbered_folders(spark, path, GENERATION) if done]
    number = complete[-1] + 1 if complete else 0
    others = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*others), "expires_at").alias("__row")
    folded = live(rows, now).groupBy(*keys).agg(latest).select(*keys, "__row.*").select(*rows.columns)
    target = f"{path}/{GENERATION}{number}"
    folded.write.mode("overwrite").partitionBy("expires_date").parquet(target)
    for old in complete[:-1]:
        delete_folder(spark, f"{path}/{GENERATION}{old}")
    return target


def entries_from_json(raw: Column) -> Column:
    """The token map of a serialized ``{"entries": {...}}``; null, a miss, when corrupt."""
    parsed = F.from_json(raw, f"struct<entries:{TOKEN_MAP},_corrupt_record:string>", {"mode": "PERMISSIVE"})
    return F.when(parsed["_corrupt_record"].isNull(), parsed["entries"])


def entries_to_json(entries: Column) -> Column:
    return F.to_json(F.struct(entries.alias("entries")))


def lookup_maps(
    texts: DataFrame, vault: DataFrame, now: Column, map_id: str = "map_id", inline: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Texts with their ``token_map``, and the misses as error rows.

    An inline map wins over the vault; without either a usable id the row is a miss. Many texts may
    share one map id: the vault side is unique, so a hot id only makes large probe partitions, which
    adaptive execution splits. A map that was written again counts once, by its latest expiry.
    """
    current = (
        live(vault, now)
        .where(F.col("entries").isNotNull())
        .groupBy(F.col("map_id").alias("__id"))
        .agg(F.max_by("entries", "expires_at").alias("__entries"))
    )
    joined = texts.join(current, texts[map_id] == current["__id"], "left").drop("__id")
    given = F.coalesce(F.col(inline), F.col("__entries")) if inline else F.col("__entries")
    resolved = joined.withColumn("token_map", given).drop("__entries", *([inline] if inline else []))
    missing = resolved.where(F.col("token_map").isNull()).drop("token_map", "text")
    return (
        resolved.where(F.col("token_map").isNotNull()),
        missing.withColumn("error", F.lit("missing_token_map")),
    )


def rehydrate_from_rows(
    texts: DataFrame,
    tokens: DataFrame,
    ids: Sequence[str],
    scope: Sequence[str],
    text: str = "text",
    out: str = "restored",
) -> DataFrame:
    """Rehydrate against token rows ``(scope…, placeholder, value)`` of any size.

    Each text looks up only the placeholders it holds; texts with none are not shuffled. ``ids`` name
    the caller's columns and may be null or repeat.
    """
    held = F.when(F.contains(text, F.lit("[")), F.array_distinct(tokens_in(F.col(text)))).otherwise(
        F.array().cast("array<string>")
    )
    # Written once: the texts may be a long plan, and the lookup reads them four times.
    keyed = stage(numbered_rows(texts.withColumn("__keys", held)), "keyed")
    mapped = attach_values(keyed, "__keys", tokens, scope, "placeholder", "value", "__map")
    return mapped.withColumn(out, rehydrate(F.col(text), F.col("__map"))).drop("__map", "__keys", ROW)
