"""Covering hashing against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import simhash
from veilspark.llm.simhash import covering_masks, fingerprint, links_within, near_duplicates


def closed(nodes, links):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def plain_print(text, n=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bits", [64, 30, 15, 7, 3])
def test_some_table_avoids_any_three_bits(bits):
    masks = covering_masks(range(bits), 3)
    chosen = combinations(range(bits), 3) if bits < 40 else (random.Random(k).sample(range(bits), 3) for k in range(5000))
    for three in chosen:
        assert any(not m & sum(1 << b for b in three) for m in masks)


def test_fingerprint_equals_a_plain_one_and_the_engines_hash(spark):
    texts = [None, "", " \t", "One", "one two", "A b C d e É Ü", "x " * 70_000 + "y", "İK z w", "a\x85b c d", "a\x0bb\x0cc"]
    assert [fingerprint(t) for t in texts] == [plain_print(t) for t in texts]
    one = spark.createDataFrame([("one two",)], "t string").select(F.xxhash64("t")).first()[0]
    assert one & (2**64 - 1) == fingerprint("One\ttwo")


@pytest.mark.parametrize("large", [2, 40, 2048])
def test_links_connect_what_all_pairs_connect(spark, large):
    draw = random.Random(7)
    prints = {draw.getrandbits(64) for _ in range(200)}
    for base in [draw.getrandbits(64) for _ in range(12)] + [0]:
        for _ in range(70):
            x = base
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                x ^= 1 << bit
            prints.add(x)
    for low in range(256):  # a dense group: every value of eight bits
        prints.add(0xABCDEF0123456700 | low)
    prints = sorted(prints)
    array = np.array(prints, dtype=np.uint64)
    pairs = [(p, q) for i, p in enumerate(prints)
             for q in array[i + 1 :][np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3].tolist()]
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long").repartition(5)
    links = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in links_within(df, 3, large).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert closed(prints, links) == closed(prints, pairs)


def test_documents(spark):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(draw.choices(words, k=120)) for _ in range(25)]
    texts = base + [b.upper().replace(" ", "\n") for b in base[:10]] + [b + " tail" for b in base[:12]]
    rows = [(k + 10, t, "x") for k, t in enumerate(texts)] + [(None, base[3], "x"), (None, "only here now", "x")]
    rows += [(5, None, "x"), (6, "", "x"), (7, " \n", "x"), (10, base[0], "x"), (8, "one", "x"), (9, "ONE", "x")]
    rows += [(100 + k, base[24], "x") for k in range(40)]
    schema = "doc_id long, text string, component_id string"
    got = near_duplicates(spark.createDataFrame(rows, schema).repartition(4))
    assert got.columns == ["doc_id", "component_id", "fingerprint"]
    prints = {t: plain_print(t) for _, t, _ in rows}
    labels = closed(set(prints.values()), [(a, b) for a in prints.values() for b in prints.values() if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t, _ in rows:
        label = labels[prints[t]]
        least[label] = min((x for x in (least.get(label), i) if x is not None), default=None)
    want = [(i, f"{prints[t]:016x}", least[labels[prints[t]]]) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
