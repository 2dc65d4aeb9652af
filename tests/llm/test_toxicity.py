"""What the toxicity model reads, and what it is calibrated to."""

import random

import numpy as np
from test_documents import prose
from veilspark.llm import toxicity


def spread_out(rng, n, bad, words=60):
    """``n`` ordinary texts and ``n`` toxic ones with one or two of many insults."""
    known = sorted(set(prose(random.Random(1), 3_000).split()))
    texts = [rng.choices(known, k=words) for _ in range(2 * n)]
    for t in texts[n:]:
        for w in rng.sample(bad, rng.randrange(1, 3)):
            t[rng.randrange(words)] = w
    return [" ".join(t) for t in texts], [0] * n + [1] * n


def test_long_tail_of_toxic_words():
    rng = random.Random(5)
    bad = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}scum" for k in range(150)]
    model = toxicity.fit(*spread_out(rng, 700, bad))
    texts, labels = spread_out(rng, 200, bad)
    got = np.array([toxicity.score_text(t, model) >= 0.3 for t in texts])
    assert got[200:].mean() > 0.85 and got[:200].mean() < 0.1


def test_words_are_read_whole():
    def read(text):
        return toxicity.codes(text).tolist()

    assert read("Idiotic idiotIC") == read("idiotic") * 2 and read("idiotic") != read("idiomatic")
    assert len({*read("Überraschung Übermut переход перевод")}) == 4
    assert read("don't, x_1") == read("don") + read("t") + read("x") + read("1")
    whole = "我们今天去公园散步然后回家吃饭"
    for k in range(len(whole)):  # every code point of a text without blanks counts
        assert read(whole[:k] + "笨" + whole[k + 1 :]) != read(whole)
    assert set(read("笨蛋")) < set(read(whole + "笨蛋" + whole))
    assert read("abc笨蛋é") == read("abc") + read("笨蛋") + read("é") and len(read("好")) == 1 and read("") == []


def test_blocks_change_nothing(monkeypatch):
    text = " ".join(["ab cd", "笨蛋我们今天", "é" * 40, "x" * 100]) * 20
    whole = toxicity.codes(text).tolist()
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert toxicity.codes(text).tolist() == whole


def test_toxic_passage_without_blanks():
    rng = random.Random(8)
    script = [chr(0x4E00 + k) for k in range(300)]
    bad = ["笨蛋", "白痴", "蠢货"]

    def text(toxic):
        t = [rng.choice(script) for _ in range(80)]
        if toxic:
            t.insert(rng.randrange(20, 80), rng.choice(bad))
        return "".join(t)

    model = toxicity.fit([text(k % 4 == 0) for k in range(600)], [int(k % 4 == 0) for k in range(600)])
    got = np.array([toxicity.score_text(text(k % 4 == 0), model) >= 0.3 for k in range(200)])
    assert got[::4].mean() > 0.9 and got.sum() - got[::4].sum() <= 10


def test_classes_weigh_as_they_occur(spark, monkeypatch):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(1_500):
        toxic = k % 8 == 0
        rows.append((k, prose(rng, 30) + (" idiot" if toxic and k % 16 else "")))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (5_000, "plain")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")

    def score():
        return toxicity.score_toxicity(docs, known).where("doc_id = 5000").first().score

    whole = score()
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 130)  # the sample is now about 1:1, the table 1:7
    assert abs(score() - whole) < 0.05 and whole < 0.3


def test_long_texts(spark):
    rng = random.Random(10)
    common, bad = sorted(set(prose(rng, 2_000).split())), "idiot scum loser moron".split()

    def text(n, toxic=0):
        words = rng.choices(common, k=n)
        for _ in range(toxic):
            words[rng.randrange(n)] = rng.choice(bad)
        return " ".join(words)

    # A few ordinary texts quote an insult: windows pass at a calibrated rate, not never.
    rows = [(k, text(60, 2 if k % 5 == 0 else 0) + (" idiot" if k % 97 == 1 else ""), int(k % 5 == 0)) for k in range(1_000)]
    clean = text(400_000).split()
    for k in range(0, len(clean), 40_000):
        clean[k] = "idiot"
    rows += [(2_000, " ".join(clean), None), (2_001, text(60, 2), None), (2_002, text(200_000) + " idiot scum moron" * 40, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    done = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).where("doc_id >= 2000").collect()}
    assert len(rows[1000][1]) > 3_000_000 and done == {2_000: 0, 2_001: 1, 2_002: 1}


def test_long_labelled_texts_take_part(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, 5_000) + (" idiot scum" * 3 if k % 2 else ""), k % 2) for k in range(60)]
    assert min(len(r[1]) for r in rows) > 32_768
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is not None
