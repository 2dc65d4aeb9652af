"""Operators on documents against brute force, on small tables with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import decontaminate as dec
from veilspark.llm import hashing, lines, mixing, setjoin, sharding, suffixes, tokens, toxicity

SCHEMA = "doc_id long, text string, source string, size string, score string, hash long, removed int, shard string, pieces int"
WORDS = "the and of to a in re er th on ing ed that with for was by at as is it he".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared = prose(rng, 30)
    base = prose(rng, 80).split()
    near = []
    for k in range(24):
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = prose(rng, 1)
        near.append(" ".join(own).upper() if k == 3 else " ".join(own))
    long = "\n".join(prose(rng, 12) for _ in range(3_000)) + "\n" + shared
    few = ["one two three four", "One  two\tthree FOUR", "x", "", " \n\t ", "é ü ñ é ü ñ", "x", "one two three four five"]
    plain = [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    mixed = [f"{prose(rng, 6)}\n{shared}\n{prose(rng, 5)}" for _ in range(6)]
    return [*near, long, long + "!", *few, *plain, *mixed, plain[0], plain[0], None, None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, None if k % 7 == 0 else f"s{k % 3}", "x", None, k, 1, "y", 0) for k, t in enumerate(texts)]
    rows += [(5, texts[5], "s1", None, None, None, None, None, None)] * 2  # repeated rows
    rows += [(None, texts[0], None, None, None, None, None, None, None), (None, None, "s0", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(df.collect(), key=repr)


def test_shards(docs, nothing):
    done = sharding.shard_rows(docs, ["doc_id"], shards=8).toPandas()
    given = docs.toPandas()
    assert len(done) == len(given)
    bytes_of = [1 + len((t or "").encode()) for t in given["text"]]
    assert done["size"].sum() == sum(bytes_of)
    for _, part in done.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    by_text = defaultdict(set)
    shard_of = dict(zip(zip(done["doc_id"].fillna(-1), done["text_crc32"].fillna(-1), strict=True), done["shard"], strict=True))
    for i, t in zip(given["doc_id"].fillna(-1), given["text"], strict=True):
        by_text[t].add(shard_of[i, zlib.crc32(t.encode()) if t is not None else -1])
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.shard_rows(nothing, ["doc_id"]).count() == 0


def test_differencing_beats_greedy():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 10_000) for _ in range(2_000)]
    sums = Counter()
    for size, shard in zip(sizes, sharding.difference(sizes, 8), strict=True):
        sums[shard] += size
    greedy = [0] * 8
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert max(sums.values()) - min(sums.values()) <= max(greedy) - min(greedy)
    assert sharding.difference([4, 5, 6, 7, 8], 2).count(0) in (2, 3)
    assert sharding.difference([], 8) == []
    assert sharding.difference([3, 2], 1) == [0, 0]


def test_token_counts(docs, nothing):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    done = tokens.count_tokens(docs, model=path)
    assert done.columns == [*docs.columns, "n_tokens", "n_bytes", "over_limit"]
    for r in done.collect():
        assert r.n_tokens == len(model.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
        assert r.over_limit == (r.n_tokens > 4096)
    assert tokens.count_tokens(nothing, model=path).count() == 0
    counter = tokens.PieceCounter(path, part_chars=3, batch_bytes=8)
    assert counter.safe
    for t in ["a  b   c ", "   ", " x", "▁ ▁a b", "a\nb c\n d", "<s> </s> é  ü", "x" * 50 + " y  ", ""]:
        assert counter.counts([t, t]) == [len(model.encode(t))] * 2


def test_toxicity(spark, nothing):
    rng = random.Random(3)
    bad = "idiot scum loser moron".split()
    rows, labels = [], []
    for k in range(400):
        words = prose(rng, 60).split()
        toxic = k % 5 == 0
        for w in bad if toxic else []:
            words[rng.randrange(60)] = w
        rows.append((k, " ".join(words), None, None, None, None, None, None, None))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None, None, None, None, None, None, None, None), (901, "", None, None, None, None, None, None, None),
             (None, "idiot " * 40, None, None, None, None, None, None, None), (902, prose(rng, 50_000), None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    done = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    assert len(done) == len(rows)
    for i, _, toxic in labels:
        assert done[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert done[i].predicted == int(done[i].score >= 0.3) and 0 <= done[i].score <= 1
    unseen = [done[i].predicted == toxic for i, _, toxic in labels if done[i].held_out]
    assert sum(unseen) >= 0.95 * len(unseen)
    assert done[900].predicted == done[901].predicted == 0 and None in done
    # Labels of held-out rows are never looked at.
    turned = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, turned).collect()}
    assert again == {i: r.score for i, r in done.items()}
    assert {r.score for r in toxicity.score_toxicity(docs, known.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, known).count() == 0


def spelled_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute_components(rows):
    sets = [spelled_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("small_list", [2, 16])
def test_similar_documents(docs, nothing, monkeypatch, small_list):
    monkeypatch.setattr(setjoin, "SMALL_LIST", small_list)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = setjoin.similar_documents(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    if small_list == 16:
        assert setjoin.similar_documents(nothing).count() == 0


@pytest.mark.parametrize("boundary", [0, 8, 64])
def test_boundary_changes_no_result(spark, monkeypatch, boundary):
    rng = random.Random(boundary)
    rows = []
    for k in range(60):
        base = [f"w{x}" for x in range(k // 6 * 10, k // 6 * 10 + 5 + k // 2)]
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = f"v{rng.randrange(9)}"
        rows.append((k, " ".join(base)))
    monkeypatch.setattr(setjoin, "choose_boundary", lambda *_: boundary)
    got = setjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_components(rows)


def test_keep_one_each(docs):
    kept = setjoin.keep_one_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    groups = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    want = {i for i, n, c in groups if n == 0 or i == c}
    blank = Counter((r.doc_id, r.text) for r in docs.collect() if not spelled_set(r.text))
    assert {i for i, _ in got} == want | {i for i, _ in blank}
    assert all(n == blank.get(key, 1) for key, n in got.items())


def test_cost_boundary():
    assert setjoin.choose_boundary([(1000, 10)], 0.0, 75) == 0
    assert setjoin.choose_boundary([(6, 1000)], 100.0, 75) >= 6


def test_words_and_shingles():
    assert len(hashing.word_hashes(b"")) == 0 and len(hashing.word_hashes(b" \t\n ")) == 0
    a, b, c = hashing.word_hashes("Ab é  aB".encode())
    assert a == c != b
    for n in (1, 4, 5, 9):
        words = hashing.word_hashes(" ".join(map(str, range(n))).encode())
        assert len(hashing.shingle_hashes(words)) == max(1, n - 4)


def units_of(text, runs, least=1):
    """(start, end, plain) of the lines, and of several lines between blank ones."""
    raw = (text or "").encode()
    out, start, open_run = [], 0, []

    def close():
        if runs and len(open_run) > 1:
            out.append((open_run[0][0], open_run[-1][1], b" ".join(p for _, _, p in open_run)))
        open_run.clear()

    for line in raw.split(b"\n"):
        end = min(len(raw), start + len(line) + 1)
        plain = b" ".join(line.lower().split())
        if plain:
            out.append((start, end, plain))
            open_run.append((start, end, plain))
        else:
            close()
        start = end
    close()
    return [u for u in out if len(u[2]) >= least]


def merged(spans):
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


@pytest.mark.parametrize("runs,least", [(True, 1), (False, 1), (False, 50)])
def test_repeated_lines(spark, docs, nothing, runs, least):
    passage = "one passage of some words that is wrapped in more than one way. it goes on for a while and ends here"
    words = passage.split()
    wrapped = ["\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n)) for n in (3, 5, 50)]
    more = [(800 + k, f"own start {k}\n\n{w.upper()}\n \nown end {k}", "s") for k, w in enumerate(wrapped * 2)]
    more += [(900, "x\nx\n\nX\nx\n\n x x", "s"), (901, "short\nshort", "s"), (902, "\n\n", "s")]
    df = docs.select("doc_id", "text", "removed").unionByName(spark.createDataFrame(more, "doc_id long, text string, removed string"))
    found = df.select("doc_id", "text").distinct().collect()
    th = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", lines._key("text").alias("h")).collect()}
    first = {}
    for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, th[r.doc_id, r.text])):
        for start, _, plain in sorted(units_of(r.text, runs, least)):
            first.setdefault(plain, (r.doc_id, r.text, start))
    done = lines.drop_repeated_lines(df, runs=runs, least=least)
    assert set(done.columns) == set(df.columns) | {"n_units", "n_removed", "kept"} and done.count() == df.count()
    for r in done.collect():
        units = units_of(r.text, runs, least)
        gone = [(s, e) for s, e, p in units if first[p] != (r.doc_id, r.text, s)]
        assert (r.n_units, r.n_removed) == (len(units), len(gone))
        assert [(x.start, x.end) for x in r.removed] == merged(gone)
        raw = (r.text or "").encode()
        for s, e in reversed(merged(gone)):
            raw = raw[:s] + raw[e:]
        assert r.kept == raw.decode()
        if runs and r.doc_id and 801 <= r.doc_id <= 805:  # however it is wrapped
            assert "PASSAGE" not in r.kept and f"own end {r.doc_id - 800}" in r.kept
    assert lines.drop_repeated_lines(nothing).count() == 0


def brute_substrings(rows):
    first, out = {}, {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        raw = t.encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    for i, t in rows:
        raw, gone = t.encode(), set()
        for k in range(len(raw) - 49):
            if i is not None and first[raw[k : k + 50]] < i:
                gone.update(range(k, k + 50))
        kept = bytes(b for k, b in enumerate(raw) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out[i, t] = (len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check_substrings(df):
    want = brute_substrings([(r.doc_id, r.text or "") for r in df.collect()])
    done = suffixes.drop_repeated_substrings(df)
    assert done.count() == df.count()
    for r in done.collect():
        n = sum(s.end - s.start for s in r.removed)
        assert (n, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id, r.text or ""]


def test_substrings(docs, nothing, spark):
    check_substrings(docs.where("doc_id is null or doc_id not in (24, 25)"))
    assert suffixes.drop_repeated_substrings(nothing).count() == 0
    odd = [(1, "a" * 400), (2, "a" * 300 + "b" + "a" * 60), (3, "ab" * 100), (4, "é" * 90), (5, "xé" + "é" * 60), (6, "a" * 49), (1, "a" * 80)]
    check_substrings(spark.createDataFrame(odd, "doc_id long, text string"))


def test_substrings_in_small_pieces(docs, monkeypatch):
    """Pieces and blocks far below a text's size change nothing. Functions run here, not in workers."""
    rng = random.Random(2)
    text = prose(rng, 400)
    monkeypatch.setattr(suffixes, "CHUNK", 97)
    whole = suffixes.Chunk([(0, 0, text.encode())])
    cut = [suffixes.Chunk([p]) for p in suffixes.pieces_of(0, text.encode())]

    def places(chunks):
        return sorted((int(p) + k, int(a)) for c in chunks for p, n, a in zip(c.place, c.count, c.anchor) for k in range(n))

    assert places([whole]) == places(cut) and len(places(cut)) == len(text) - 49


def test_doubled_ranks():
    rng = random.Random(8)
    data = "".join(rng.choice("ab") for _ in range(300)) * 2 + "".join(rng.choice("ab") for _ in range(200))
    raw = np.frombuffer(data.encode(), dtype=np.uint8)
    at = np.arange(len(raw) - 49)
    rank = suffixes.doubled_ranks(raw, at)
    strings = [data[k : k + 50] for k in at]
    count = Counter(strings)
    assert all((r >= 0) == (count[s] > 1) for r, s in zip(rank, strings, strict=True))
    assert len({(r, s) for r, s in zip(rank, strings, strict=True) if r >= 0}) == sum(n > 1 for n in count.values())


def test_contained_items(spark, docs, nothing, texts):
    shared = texts[-6].split("\n")[1]
    words = shared.split()
    items = [(1, shared), (2, " ".join([*words[:-6], *WORDS[:6]])), (3, "nothing like it " * 9), (4, None), (5, ""), (6, "one two three four"),
             (7, shared), (7, texts[40]), (None, " ".join(words[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dec.contained_items(docs, bench).select("doc_id", "item_id", "n_item", "n_shared").collect()
    want = set()
    for r in docs.collect():
        for i, t in items:
            own = spelled_set(t)
            both = len(own & spelled_set(r.text))
            if own and both * 100 >= len(own) * 75:
                want.add((r.doc_id, i, len(own), both))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    clean = dec.decontaminate(docs, bench)
    bad = {i for i, *_ in want}
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect() if r.doc_id is not None} == {r.doc_id for r in docs.collect()} - bad - {None}
    assert dec.contained_items(nothing, bench).count() == 0 and dec.contained_items(docs, bench.limit(0)).count() == 0


def test_mixing_of_rows_without_an_id(spark):
    """Documents without an id, or with one id, draw by their texts, and spread over partitions."""
    rows = [(None, f"text {k}", "a") for k in range(2000)] + [(7, f"more {k}", "a") for k in range(500)]
    rows += [(None, "same", "b")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix_sources(df, power=0.5, seed="t").select("text", "shuffle_key").collect()
    counts = Counter(r.text for r in mixed)
    drawn = [counts[f"text {k}"] for k in range(2000)]
    assert len(set(drawn)) > 2 and 0 in drawn  # not one draw for all
    assert len({counts[f"more {k}"] for k in range(500)}) > 2
    assert counts["same"] % 400 == 0  # equal rows draw alike
    # Every copy has a place of its own in the shuffle, equal rows included.
    assert len({r.shuffle_key for r in mixed}) == len(mixed)


@pytest.mark.parametrize("most", [mixing.MAX_BROADCAST, 0])
def test_mixing(spark, docs, nothing, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", most)
    mixed = mixing.mix_sources(docs, weights={"s0": 3.0, "s1": 1.0, "null": 1.0}, seed="t")
    got = mixed.collect()
    rate = {r["__source"]: r["rate"] for r in mixing.repetition_rates(docs, "source", F.coalesce(F.octet_length("text"), F.lit(0)) + 1, {"s0": 3.0, "s1": 1.0, "null": 1.0}, 0.5).collect()}
    assert rate["s2"] == 0.0 and {r.source for r in got} <= {"s0", "s1", None}
    counts = Counter((r.doc_id, r.text) for r in got)
    times = Counter((r.doc_id, r.text) for r in docs.collect())
    for r in docs.collect():
        text = hashlib.md5((r.text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"t:{'null' if r.doc_id is None else r.doc_id}:{text}:1".encode()).hexdigest()[:13], 16) / 2**52
        mean, k = rate[r.source], 0
        p = c = np.exp(-mean)
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        if (r.doc_id, r.source) != (5, "s2"):
            assert counts[r.doc_id, r.text] == k * times[r.doc_id, r.text] or r.doc_id == 5
    assert sorted(r.copy for r in got if r.doc_id == 3) == list(range(1, counts[3, docs.where("doc_id = 3").first().text] + 1))
    assert mixing.mix_sources(nothing).count() == 0
    many = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    one = many.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), "text", F.lit("b").alias("source"))
    made = mixing.mix_sources(many.unionByName(one), weights={"a": 0.5, "b": 0.5}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in made}
    assert abs(n["a"] - 1500) < 200 and abs(n["b"] - 1500) < 200  # the mean of b is a sum of pieces
