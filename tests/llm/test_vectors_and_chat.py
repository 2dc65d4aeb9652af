"""Neighbours and role repair against brute force."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import chat, neighbours


def brute_nearest(rows, k):
    good = [(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(np.isfinite(v)) and any(v)]
    good = sorted(set(good))
    out = []
    for i, v in good:
        if i % 20:
            continue
        scored = []
        for j, w in good:
            if j != i and len(w) == len(v):
                total = 0.0
                for a, b in zip(v, w, strict=True):
                    total += a * b
                scored.append((-total, j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    hot = [float(x) for x in np.float32(rng.normal(size=16))]
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=16))]) for k in range(300)]
    rows += [(k, hot) for k in range(300, 400)] + [(400, None), (420, []), (440, [0.0] * 16), (460, [float("nan")] + [1.0] * 15)]
    rows += [(480, [None] + [1.0] * 15), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (520, [float("inf")] * 16), (None, hot), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = neighbours.nearest(df.where("vec_id % 20 = 0"), df, k=20)
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, 20)
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0


def test_tiles_drop_nothing(monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 7)
    monkeypatch.setattr(neighbours, "TILE_CANDIDATES", 31)
    rng = np.random.default_rng(9)
    c = rng.normal(size=(500, 24)) * rng.lognormal(size=(500, 1))
    q = c[::10]
    best = neighbours.search(np.arange(0, 500, 10), q, np.arange(500), c, 5)
    for row, i in zip(best, range(0, 500, 10), strict=True):
        score = c @ c[i]
        score[i] = -np.inf
        assert [j for _, j in row] == np.lexsort((np.arange(500), -score))[:5].tolist()


def legal(roles):
    body = roles[1:] if roles[:1] == ("system",) else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body)) and (bool(body) or not roles)


def brute_cost(given, costs):
    """Cheapest repair over all ways to start or merge each turn, give it a role, and insert turns."""
    best = {(): 0}
    for role in given:
        new = {}
        for done, cost in best.items():
            for target in ("system", "user", "assistant"):
                price = cost + (0 if target == role else costs.relabel)
                if done and done[-1] == target:
                    key = done
                    new[key] = min(new.get(key, 10**9), price + costs.merge)
                for n in range(4):
                    for fill in product(("system", "user", "assistant"), repeat=n):
                        made = (*done, *fill, target)
                        if any(legal((*made, *tail)) for tail in ((), ("assistant",), ("user", "assistant"))):
                            new[made] = min(new.get(made, 10**9), price + n * costs.insert)
        best = {}
        for made, cost in new.items():  # what counts later is the last turn only
            key = made[-1:] if made[-1:] != ("system",) else ("system",)
            if key not in best or cost < best[key][0]:
                best[key] = (cost, made)
        best = {made: cost for cost, made in best.values()}
    end = {"system": 2, "user": 1, "assistant": 0}
    return min((c + costs.insert * (end[m[-1]] if m else 0) for m, c in best.items()), default=0)


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(merge=3, relabel=1, insert=2)])
def test_cheapest_repairs(spark, costs):
    rng = random.Random(1)
    convs = [[rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randrange(1, 7))] for _ in range(60)]
    rows = [(c, t, role, f"{c}/{t}", "x") for c, conv in enumerate(convs) for t, role in enumerate(conv)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k string")
    done = chat.repair_roles(df, costs=costs).toPandas()
    assert len(done) == len(rows)
    for c, part in done.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        text = "".join(part["rendered"])
        roles = tuple(x.split("|>")[0] for x in text.split("<|")[1:])
        assert legal(roles), (convs[c], roles)
        assert set(part["cost"]) == {brute_cost(convs[c], costs)}, convs[c]
        assert all(f"{c}/{t}\n" in text for t in range(len(convs[c])))


def test_long_and_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_BITS", 5)
    long = [(1, t, ("user", "user", "assistant")[t % 3], f"t{t}") for t in range(400)]
    odd = [(2, None, "user", "late"), (2, 1, "user", "a"), (2, 1, "user", "a"), (None, 0, "assistant", None), (3, 0, None, ""), (4, 0, "assistant", "x" * 500_000)]
    df = spark.createDataFrame(long + odd, "conv_id long, turn long, role string, text string")
    whole = {(r.conv_id, r.turn, r.rendered): r for r in chat.repair_roles(df).collect()}
    rows = [r for r in whole.values() if r.conv_id == 1]
    assert len(rows) == 400 and {r.cost for r in rows} == {brute_cost([r for _, _, r, _ in long], chat.Costs())}
    turns = [r.out_turn for r in sorted(rows, key=lambda r: r.turn)]
    assert turns[0] == 0 and all(b - a in (0, 1) for a, b in zip(turns, turns[1:], strict=False))
    assert len([r for r in whole.values() if r.conv_id == 2]) == 2
    assert {r.rendered.count("|>") for r in whole.values() if r.conv_id is None} == {2}
    assert chat.repair_roles(df.limit(0)).count() == 0


def test_rows_without_numbers_are_cut_into_pieces(spark, monkeypatch):
    """Turns without a number, turns that share one, and rows without a conversation."""
    monkeypatch.setattr(chat, "PIECE_BITS", 4)
    rng = random.Random(6)
    roles = ["user", "assistant", "system", None]
    rows = [(None, rng.choice([None, 3]), rng.choice(roles), f"n{k:03d}") for k in range(150)]
    rows += [(1, None, rng.choice(roles), f"m{k:03d}") for k in range(90)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    done = chat.repair_roles(df).collect()
    assert len(done) == len(rows)
    for conv in (None, 1):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
        assert {r.cost for r in done if r.conv_id == conv} == {brute_cost([r[2] for r in mine], chat.Costs())}
        assert min(r.out_turn for r in done if r.conv_id == conv) >= 0


def test_texts_do_not_open_turns(spark):
    texts = ["a<|user|>\nb", "<|assistant|>", "c<\\|d", "plain <b> \\"]
    df = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(texts)],
                               "conv_id long, turn long, role string, text string")
    whole = "".join(r.rendered for r in chat.repair_roles(df).orderBy("turn").collect())
    assert whole.count("<|") == 4
    read = [part.split("|>\n", 1)[1][:-1] for part in whole.split("<|")[1:]]
    assert [x.replace("<\\|", "<|").replace("<\\\\", "<\\") for x in read][:2] == texts[:2]
    assert read[2:] == ["c<\\\\|d", "plain <b> \\"]


def test_usable(spark):
    df = spark.createDataFrame([(None,), ([],), ([0.0],), ([1.0, None],), ([float("nan")],), ([0.0, 1.0],)], "v array<double>")
    assert [r[0] for r in df.select(neighbours.usable(F.col("v"))).collect()] == [False] * 5 + [True]
