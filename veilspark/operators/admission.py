"""Token-bucket admission over a table of requests.

Each caller has a bucket of ``capacity`` tokens that refills at ``refill_per_ms``; a request costs
one. The outcome of a request depends on everything the caller did since its bucket was last full, so
the work is arranged around that:

* requests of one caller in the same millisecond are first folded into one row with a count, which
  bounds a caller's rows by elapsed time, however many requests it sent;
* an idle gap long enough to fill the bucket makes the future independent of the past, so a caller is
  cut into independent stretches there;
* the stretches are spread over the cluster, sorted, and scanned once with two numbers of state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.kinds import UNLIMITED_ROUTES
from veilspark.operators.lookup import join_null_safe
from veilspark.operators.staging import stage


def refill_rate(limit: int, window_sec: int) -> float:
    """Tokens per millisecond for ``limit`` requests per window."""
    return limit / (window_sec * 1000)


def full_after_ms(capacity: float, refill_per_ms: float) -> int | None:
    """Idle time after which the bucket is certainly full again; None when it never refills."""
    if refill_per_ms <= 0:
        return None
    ms = max(1, math.ceil(capacity / refill_per_ms))
    while ms * refill_per_ms < capacity:
        ms += 1
    return ms


def caller_of(api_key: str = "api_key", client_ip: str = "client_ip"):
    """Requests are counted per API key, or per address when there is none."""
    return F.coalesce(F.col(api_key), F.col(client_ip))


def _stretches(moments: DataFrame, full_ms: int | None) -> DataFrame:
    """Add ``__stretch``. Gaps are looked for between time slots of one refill period, so the window
    that numbers the stretches sees one row per caller and slot."""
    if full_ms is None:
        return moments.withColumn("__stretch", F.lit(0).cast("long"))
    slotted = moments.withColumn("__slot", F.floor(F.col("ts_ms") / F.lit(full_ms)).cast("long"))
    slots = slotted.groupBy("caller", "__slot").agg(F.min("ts_ms").alias("__lo"), F.max("ts_ms").alias("__hi"))
    order = Window.partitionBy("caller").orderBy("__slot")
    fresh = F.coalesce(F.col("__lo") - F.lag("__hi").over(order) >= full_ms, F.lit(True))
    numbered = slots.withColumn("__fresh", fresh.cast("long")).withColumn("__stretch", F.sum("__fresh").over(order))
    found = join_null_safe(slotted, numbered.select("caller", "__slot", "__stretch"), ["caller", "__slot"])
    return found.drop("__slot")


def _scan(capacity: float, refill_per_ms: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tokens, last = None, 0.0, 0
        for batch in batches:
            before, admitted = [], []
            for caller, stretch, ts, n in zip(
                batch["caller"], batch["__stretch"], batch["ts_ms"].tolist(), batch["n"].tolist()
            ):
                if at != (caller, stretch):
                    at, tokens, last = (caller, stretch), float(capacity), ts
                if ts > last:
                    tokens, last = min(capacity, tokens + (ts - last) * refill_per_ms), ts
                taken = min(n, math.floor(tokens))
                before.append(float(tokens))
                admitted.append(taken)
                tokens -= taken
            yield pd.DataFrame(
                {"caller": batch["caller"], "ts_ms": batch["ts_ms"], "before": before, "admitted": admitted}
            )

    return run


def admit(
    requests: DataFrame,
    capacity: float,
    refill_per_ms: float,
    order: Sequence[str] = ("request_id",),
) -> DataFrame:
    """Add ``allowed, retry_after_ms, remaining`` to requests with ``caller`` and ``ts_ms``.

    Requests without a caller share one bucket; ``ts_ms`` may not be null. Requests of one
    millisecond are taken in the order of the columns ``order``. A denied request
    that will never be satisfiable (no refill) has a null ``retry_after_ms``.
    """
    moments = requests.groupBy("caller", "ts_ms").agg(F.count("*").alias("n"))
    cut = _stretches(moments, full_after_ms(capacity, refill_per_ms))
    outcome = (
        cut.select("caller", "__stretch", "ts_ms", "n")
        .repartition("caller", "__stretch")
        .sortWithinPartitions("caller", "__stretch", "ts_ms")
        .mapInPandas(_scan(capacity, refill_per_ms), "caller string, ts_ms long, before double, admitted long")
    )
    place = F.row_number().over(Window.partitionBy("caller", "ts_ms").orderBy(*order))
    ranked = join_null_safe(requests.withColumn("__place", place), outcome, ["caller", "ts_ms"])
    allowed = F.col("__place") <= F.col("admitted")
    if refill_per_ms > 0:
        wait = F.ceil((1 - (F.col("before") - F.col("admitted"))) / F.lit(float(refill_per_ms))).cast("long")
    else:
        wait = F.lit(None).cast("long")
    return ranked.withColumns(
        {
            "allowed": allowed,
            "retry_after_ms": F.when(allowed, F.lit(0).cast("long")).otherwise(wait),
            "remaining": F.when(allowed, F.floor(F.col("before") - F.col("__place"))).otherwise(0).cast("int"),
        }
    ).drop("__place", "before", "admitted")


def _replay(limit: int, window_ms: int, ends: bool):
    """Decide requests in order, segment by segment, or give only the state at each segment's end.

    Tokens are whole units of ``1 / window_ms``: a request costs ``window_ms``, a millisecond brings
    ``limit``, and the bucket holds ``limit * window_ms``. So nothing is ever rounded.
    """
    full = limit * window_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, units, last, closed = None, 0, 0, []
        for batch in batches:
            allowed, wait, left = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("__range", "__caller", "__ts", "__units", "__last"))
            for part, caller, ts, given, since in zip(*columns):
                if at != (part, caller):
                    if at is not None:
                        closed.append((*at, units, last))
                    at, units, last = (part, caller), full if given is None else given, ts if given is None else since
                if ts > last:
                    units, last = min(full, units + (ts - last) * limit), ts
                passed = units >= window_ms
                if passed:
                    units -= window_ms
                allowed.append(passed)
                wait.append(0 if passed else -(-(window_ms - units) // limit))
                left.append(units // window_ms if passed else 0)
            if not ends:
                kept = [c for c in batch.schema.names if c not in ("__range", "__caller", "__ts", "__units", "__last", "__place")]
                out = [pa.array(allowed, pa.bool_()), pa.array(wait, pa.int64()), pa.array(left, pa.int32())]
                yield pa.record_batch([*(batch.column(c) for c in kept), *out], names=[*kept, "allowed", "retry_after_ms", "remaining"])
        if ends:
            if at is not None:
                closed.append((*at, units, last))
            parts = list(zip(*closed)) if closed else [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(parts, kinds)], names=["range", "caller", "units", "last"])

    return run


def admit_spread(
    requests: DataFrame, limit: int, window_ms: int, order: Sequence[str] = ("request_id",)
) -> DataFrame:
    """``allowed, retry_after_ms, remaining`` as :func:`admit` adds them, with one caller spread over many tasks.

    Requests are dealt to ranges of caller, time and ``order``; a caller's requests in a range are a
    segment. A segment is decided alone once the tokens at its start are known. They are guessed for a
    busy caller: used up, but for the fraction that has come since its first request. All segments run
    at once from their guesses, and those that the segment before ended otherwise run again from there,
    until every guess has come true; then every decision is that of one bucket. A segment forgets its
    start when its bucket runs empty or fills up, so a few rounds suffice. Only callers that cross the
    end of a range have more than one segment, at most two for each end; these states are all that the
    driver sees. Requests of one millisecond may be many: ranges cut them, too.

    Arithmetic is in whole numbers, so a bucket never gains or loses a request by rounding. ``caller``
    is a string and may be null, ``ts_ms`` may not be; ``limit`` is the bucket's size and what a window
    brings. Empty tables give no rows.
    """
    if limit < 1 or window_ms < 1:
        raise ValueError("limit and window_ms must be positive")
    keyed = requests.drop("allowed", "retry_after_ms", "remaining").withColumns(
        {"__caller": F.col("caller").cast("string"), "__ts": F.col("ts_ms").cast("long"), "__tie": F.monotonically_increasing_id()}
    )
    keys = ["__caller", "__ts", *order, "__tie"]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = stage(dealt.withColumn("__place", F.monotonically_increasing_id()), "requests")
    ranged = placed.withColumn("__range", F.shiftright("__place", 33))
    segments = ranged.groupBy("__caller", "__range").agg(F.min("__ts").alias("first"), F.max("__ts").alias("last"))
    several = segments.groupBy("__caller").agg(F.count("*").alias("n")).where("n > 1").select("__caller")
    found = join_null_safe(segments, several, ["__caller"]).orderBy("__caller", "__range").collect()

    entries: dict[tuple, tuple[int, int]] = {}
    before: dict[tuple, tuple] = {}
    for caller, group in groupby(found, key=lambda r: r["__caller"]):
        rows = list(group)
        for a, b in zip(rows, rows[1:]):
            here = (b["__range"], caller)
            before[here] = (a["__range"], caller)
            entries[here] = ((a["last"] - rows[0]["first"]) * limit % window_ms, a["last"])
    spark = requests.sparkSession

    def started(chosen: dict, how: str) -> DataFrame:
        table = spark.createDataFrame([(*k, *v) for k, v in chosen.items()], "__range long, __caller string, __units long, __last long")
        joined = join_null_safe(ranged, F.broadcast(table), ["__range", "__caller"], how)
        return joined.repartition("__range").sortWithinPartitions("__range", "__place")

    ends: dict[tuple, tuple[int, int]] = {}
    todo = {(r["__range"], r["__caller"]): (limit * window_ms, r["first"]) for r in found} | entries
    while todo:
        done = started(todo, "inner").mapInArrow(_replay(limit, window_ms, True), "range long, caller string, units long, last long")
        ends |= {(r["range"], r["caller"]): (r["units"], r["last"]) for r in done.collect()}
        wrong = {k: ends[b] for k, b in before.items() if ends[b] != entries[k]}
        entries |= wrong
        todo = wrong
    columns = [c for c in ranged.columns if not c.startswith("__")]
    schema = T.StructType(
        [*(ranged.schema[c] for c in columns), T.StructField("allowed", T.BooleanType()),
         T.StructField("retry_after_ms", T.LongType()), T.StructField("remaining", T.IntegerType())]
    )
    return started(entries, "left").mapInArrow(_replay(limit, window_ms, False), schema)


def unlimited_route(route: str) -> Column:
    """Health and metrics routes; a query string does not matter."""
    return F.coalesce(F.substring_index(route, "?", 1).isin(*UNLIMITED_ROUTES), F.lit(False))


def decisions_of_free() -> dict[str, Column]:
    """What a request that is not limited gets."""
    return {
        "allowed": F.lit(True),
        "retry_after_ms": F.lit(0).cast("long"),
        "remaining": F.lit(None).cast("int"),
    }


def rate_limit(
    requests: DataFrame,
    limit: int,
    window_sec: int = 60,
    order: Sequence[str] = ("request_id",),
    spread: bool = False,
) -> DataFrame:
    """Admission with the server's settings, for requests with ``caller, ts_ms, route``.

    A limit of zero or less turns it off, and health and metrics routes are never limited. Adds
    ``retry_after_sec`` for denied requests. With ``spread`` one caller is spread over many tasks, as
    :func:`admit_spread` does.
    """
    unlimited = decisions_of_free()
    if limit <= 0:
        return with_retry_after(requests.withColumns(unlimited))
    free = unlimited_route("route")
    if spread:
        counted = admit_spread(requests.where(~free), limit, window_sec * 1000, order)
    else:
        counted = admit(requests.where(~free), limit, refill_rate(limit, window_sec), order)
    return with_retry_after(counted.unionByName(requests.where(free).withColumns(unlimited)))


def with_retry_after(decisions: DataFrame) -> DataFrame:
    seconds = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("retry_after_ms") / 1000).cast("long"))
    return decisions.withColumn("retry_after_sec", F.when(~F.col("allowed"), seconds))
