"""Vault lifetimes and sweeps, limiter state, conversation streams and cards in digit groups."""

import json
import os
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F
from test_streams import REQ, bucket_loop

from veilspark.operators.batch import redact_batch
from veilspark.operators.detect import CREDIT_CARD, CREDIT_CARD_SUBSPAN, detect
from veilspark.operators.numbering import with_rank
from veilspark.operators.policy import Policy
from veilspark.operators.vault import VAULT, later, lookup_as_of, read_vault, sweep_vault, swept_path, utc_day
from veilspark.streaming.conversations import redact_conversation_stream
from veilspark.streaming.stateful import admit_stream
from veilspark.streaming.stateless import drain


def batches(spark, rows, schema, folder):
    """Lists of rows as a stream, one micro-batch each."""
    for k, part in enumerate(rows):
        path = f"{folder}/in/part-{k}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part-*")


def test_ranks(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice([None, *range(40)])) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = {r.id: r.rank for r in with_rank(df, ("v", "id")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}
    assert sorted(r.rank for r in with_rank(df, ("v",)).collect()) == list(range(1, 501))
    assert with_rank(df.limit(0), ("v",)).count() == 0


class SerialVault:
    """A bounded vault as one process keeps it."""

    def __init__(self, most, life):
        self.most, self.life, self.maps = most, life, {}

    def store(self, name, now):
        self.maps = {k: end for k, end in self.maps.items() if end > now}
        if len(self.maps) >= self.most:
            self.maps.pop(next(iter(self.maps)))
        self.maps[name] = now + self.life

    def has(self, name, now):
        return self.maps.get(name, now) > now


@pytest.mark.parametrize("most,life", [(5, 1000), (40, 100), (3, 1)])
def test_lookups_equal_a_serial_vault(spark, most, life):
    draw, clock, events = random.Random(most), 0, []
    for k in range(120):
        clock += draw.choice([0, 1, 7, 30, 90])
        events.append((f"m{k:03d}", clock))
    asked = [(i, f"m{draw.randint(-3, 119):03d}", draw.randint(0, clock + 200)) for i in range(400)]
    vault, want, at = SerialVault(most, life), {}, 0
    for i, name, when in sorted(asked, key=lambda a: a[2]):
        while at < len(events) and events[at][1] <= when:
            vault.store(*events[at])
            at += 1
        want[i] = vault.has(name, when)
    rows = spark.createDataFrame(events * 2, "map_id string, t int").select(
        "map_id", F.create_map(F.lit("[A_1]"), "map_id").alias("entries"),
        F.timestamp_millis(F.col("t")).alias("created_at"),
    ).withColumn("expires_at", later(F.col("created_at"), life))
    texts = spark.createDataFrame(asked, "i int, map_id string, t int").withColumn("at", F.timestamp_millis(F.col("t")))
    got = lookup_as_of(texts, rows, "at", most).collect()
    assert {r.i: r.token_map is not None for r in got} == want and any(want.values()) and not all(want.values())
    assert all(r.token_map is None or r.token_map["[A_1]"] == r.map_id for r in got)


def test_sweep_survives_a_killed_one(spark, tmp_path):
    def rows(names, second):
        made = F.timestamp_seconds(F.lit(second))
        return spark.createDataFrame([(n, {"[A_1]": n}) for n in names], "map_id string, entries map<string,string>").select(
            "map_id", F.col("map_id").alias("scope_id"), "entries", made.alias("created_at"),
            later(made, 900_000).alias("expires_at"), utc_day(later(made, 900_000)).alias("expires_date"),
        )

    path = str(tmp_path / "vault")
    assert swept_path(spark, path) is None
    old, new = rows(["a", "b"], 0), rows(["c", "d"], 86_400 * 3)
    now = F.timestamp_seconds(F.lit(86_400 * 3 + 10))
    sweep_vault(spark, old.unionByName(new).unionByName(new), path, F.timestamp_seconds(F.lit(1)))
    seen = read_vault(spark, swept_path(spark, path))
    assert sorted(r.map_id for r in seen.collect()) == ["a", "b", "c", "d"]  # written twice, there once
    # A sweep that stops half way leaves a folder without the mark; readers do not see it.
    broken = f"{path}/generation-1"
    shutil.copytree(f"{path}/generation-0", broken)
    os.remove(f"{broken}/_SUCCESS")
    assert swept_path(spark, path).endswith("generation-0")
    target = sweep_vault(spark, seen, path, now)
    assert target == broken == swept_path(spark, path)
    kept = read_vault(spark, target)
    assert sorted((r.map_id, r.entries["[A_1]"]) for r in kept.collect()) == [("c", "c"), ("d", "d")]
    assert kept.schema.simpleString() == spark.createDataFrame([], VAULT).schema.simpleString()
    assert len([d for d in os.listdir(target) if d.startswith("expires_date")]) == 1  # the expired day is gone
    # Readers of the generation before can still finish; the one before that goes.
    assert seen.count() == 4
    sweep_vault(spark, kept, path, now)
    assert sorted(os.listdir(path)) == ["generation-1", "generation-2"]


def test_limiter_state_is_bounded_and_no_request_is_lost(spark, tmp_path):
    draw, parts, rid = random.Random(3), [], 0
    for k in range(6):
        part = []
        for _ in range(300):
            # New callers all the time, one that never rests, and one without a name.
            caller = draw.choice(["hot", None, f"c{k}-{draw.randint(0, 149)}"])
            part.append((caller, rid, k * 100_000 + draw.randint(0, 2_000), "/v1/redact"))
            rid += 1
        parts.append(part)
    late = [("c0-1", rid, 5, "/v1/redact"), ("hot", rid + 1, 7, "/v1/redact")]
    parts.append(late)
    stream = batches(spark, parts, REQ, str(tmp_path))
    capacity, rate, most = 2, 1 / 4000, 64
    out, kept = f"{tmp_path}/out", []
    query = (
        admit_stream(stream, capacity, rate, max_keys=most).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    shards = most // 32
    assert all(o["numRowsTotal"] <= shards for p in query.recentProgress for o in p["stateOperators"])
    state = spark.read.format("statestore").load(f"{tmp_path}/progress")
    kept = [b for r in state.selectExpr("value.*").collect() for b in json.loads(r[0][0] if isinstance(r[0], tuple) else r[0])]
    assert len(kept) < 320  # of about 900 callers: those of the last busy batches
    got = {r.request_id: (r.allowed, r.retry_after_ms, r.remaining) for r in spark.read.parquet(out).collect()}
    on_time = [r for part in parts[:-1] for r in part]
    assert {k: v for k, v in got.items() if k < rid} == bucket_loop(on_time, capacity, rate)
    assert {rid, rid + 1} <= got.keys() and got[rid][0]


CHATS = "conv long, turn long, at timestamp, text string"


def test_conversation_stream_equals_batch(spark, tmp_path):
    import datetime

    draw = random.Random(5)
    people = [f"p{k}@x.org" for k in range(6)]
    rows = []
    for conv in (None, 1, 2, 3):
        for turn in range(9):
            text = " and ".join(draw.choices([*people, "nothing", "415-555-0101", "123-45-6789", "Mr. Zed Zo"], k=draw.randint(0, 4)))
            rows.append((conv, turn, datetime.datetime(2024, 1, 1, 0, 0, turn, 123456), text))
    parts = [[r for r in rows if r[1] // 3 == k] for k in range(3)]
    for p in parts:
        draw.shuffle(p)
    policy = Policy("redact", {"PHONE": "mask", "SSN": "block"})
    done = drain(redact_conversation_stream(batches(spark, parts, CHATS, str(tmp_path)), ("conv",), ("turn",), policy=policy), "c")
    want = redact_batch(spark.createDataFrame(rows, CHATS), ("conv", "turn"), ("conv",), ("turn",), policy=policy)
    shown = ("conv", "turn", "at", "redacted", "entities", "blocked")
    assert sorted(map(str, done.select(*shown).collect())) == sorted(map(str, want.texts.select(*shown).collect()))
    fresh = done.select("conv", F.explode("new_tokens").alias("t")).select("conv", "t.placeholder", "t.value")
    assert sorted(map(str, fresh.collect())) == sorted(map(str, want.tokens.select("conv", "placeholder", "value").collect()))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_cards(text):
    found, last = [], 0
    words = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", text)]
    for i, (start, _) in enumerate(words):
        if start < last:
            continue
        best = None
        for j in range(i, len(words)):
            if j > i and not (words[j][0] - words[j - 1][1] == 1 and text[words[j - 1][1]] in " -"):
                break
            digits = re.sub("[ -]", "", text[start : words[j][1]])
            if 13 <= len(digits) <= 19 and luhn(digits):
                best = words[j][1]
        if best:
            found.append((start, best))
            last = best
    return found


def test_cards_in_digit_groups(spark):
    draw = random.Random(8)
    card = "4111 1111 1111 1111"
    texts = [f"{card} 123", f"9 {card}", f"x{card}", f"{card} 12x", f"{card}  5", f"é{card}", f"{card}-{card}", "41111111111111111", "", "none"]
    for _ in range(150):
        groups = ["".join(draw.choices("0123456789", k=draw.choice([1, 2, 3, 4, 4, 4, 6, 13, 16]))) for _ in range(draw.randint(1, 12))]
        texts.append("".join(g + draw.choice([" ", "-", "  ", " a", "."]) for g in groups) + draw.choice(["", card, "4111111111111111"]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in detect(df, detectors=(CREDIT_CARD_SUBSPAN,)).collect()}
    assert got == {i: plain_cards(t) for i, t in enumerate(texts)}
    assert got[0] == [(0, 19)] and got[1] == [(2, 21)]
    plain = {r.id: len(r.spans) for r in detect(df, detectors=(CREDIT_CARD,)).collect()}
    assert plain[0] == 0  # the default does not try shorter candidates
    long = spark.createDataFrame([("1 " * 4000 + "x " + card + " 7" * 4000,)], "text string")
    ((spans,),) = detect(long, detectors=(CREDIT_CARD_SUBSPAN,)).select("spans").collect()
    assert spans
