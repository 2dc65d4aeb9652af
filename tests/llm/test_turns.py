"""Conversation repair against a plain search from the end over whole conversations."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from veilspark.llm import turns
from veilspark.llm.queries import damaged_conversations, op13_conversation_repair
from veilspark.llm.turns import repair_conversations

WS = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def opened(base):
    """Best of going on at once or after one or two insertions, for each state."""
    out = {}
    for q in "0sua":
        found, p, before = [], q, ()
        for n in range(3):
            if p in base:
                found.append((base[p][0] + 5 * n, "I" * n + base[p][1], before + base[p][2]))
            p = NEXT[p]
            before += ((ROLE[p], ""),)
        out[q] = min(found)
    return out


def repaired(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(WS)
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    best = opened({"0": (0, "", ()), "a": (0, "", ())})
    for (_, _, role, text), fault in reversed(list(zip(rows, faults))):
        base, more, initial = {}, 5 if fault == "t" else 0, role[:1]
        for q in "0sua":
            found = [(2 + best[q][0], "D" + best[q][1], best[q][2])]
            if fault not in ("b", "d"):
                if (initial, q) == ("s", "0") or initial == NEXT[q]:
                    cost, audit, rest = best[initial]
                    found.append((more + cost, "K" + audit, ((role, text), *rest)))
                cost, audit, rest = best[NEXT[q]]
                found.append((1 + more + cost, "R" + audit, ((ROLE[NEXT[q]], text), *rest)))
            base[q] = min(found, key=lambda f: f[:2])
        best = opened(base)
    cost, audit, rest = best["0"]
    text = "\n".join(f"{r}:{t}" for r, t in rest)
    count = faults.count
    return (gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), rest


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def some_rows(seed):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "u", ""], [None, "", " \t", "a.", "b", "Hi!", "x? ", "é." * 99, "z" * 70]
    rows = []
    for conv in (None, 1, 2, 3, 4, 5):
        for i in range(draw.randint(5, 90)):
            rows.append((conv, draw.choice([None, i, i, draw.randint(0, 20)]), draw.choice(roles), draw.choice(texts)))
    rows += [(9, i, draw.choice(["user"] * 3 + ["assistant"]), f"t{i}.") for i in range(400)]
    rows += [(10, 7, "user", "same.")] * 50 + [(11, t, "user", f"{t}.") for t in range(40)]
    return rows


@pytest.mark.parametrize("partitions", [2, 17])
def test_query_equals_a_plain_search(spark, tmp_path, partitions):
    rows = some_rows(partitions)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        # Without merged partitions the long conversations are cut into several segments.
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = {r[0]: tuple(r[1:]) for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = groups(damage(rows))
    none = (0, 0, 0, 0, 0, 0, "", turns.EMPTY_DIGEST)
    assert got == {c: repaired(found[c])[0] if c in found else none for c in groups(rows)}


def test_messages_are_the_repaired_rows(spark):
    rows = [r for r in some_rows(5) if r[2] is not None and r[3] is not None]
    done = repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {}
    for r in sorted(done.messages().collect(), key=lambda r: (str(r.conv), r.number)):
        got.setdefault(r.conv, []).append((r.role, r.text))
    want = {c: list(repaired(g)[1]) for c, g in groups(rows).items()}
    assert got == {c: rest for c, rest in want.items() if rest}


def test_clean_extra_and_empty(spark):
    rows = [(1, 0, "system", "Be kind.", 5), (1, 1, "user", "Hi.", 6), (1, 2, "assistant", "Hello!", 7)]
    df = spark.createDataFrame(rows, SCHEMA + ", place int")
    (found,) = repair_conversations(df).conversations.collect()
    assert (found.cost, found.audit, found.illegal) == (0, "KKK", 0)
    assert repair_conversations(df.limit(0)).conversations.count() == 0
    assert damaged_conversations(df.limit(0)).count() == 0


def test_runs_by_binary_powers_equal_single_steps():
    draw = np.random.default_rng(3)
    for code in range(16):
        for length in (1, 2, 3, 7, 64, 1000):
            after = tuple(draw.integers(0, 30, 4).tolist())
            want = after
            for _ in range(length):
                want = turns.step_back(code, want)
            got = turns.through(turns.run_matrix(code, length), after)
            assert tuple(min(x, turns.FAR) for x in want) == got
