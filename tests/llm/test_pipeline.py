"""The pipeline's stages, each against brute force on what its predecessor kept."""

import hashlib
import math
import tracemalloc
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_documents import brute_components, prose, spelled_set

import random

from veilspark.llm import setjoin, toxicity
from veilspark.llm.toxicity import score_toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def write_tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    rng = random.Random(11)
    passage = prose(rng, 30)
    texts = [prose(rng, rng.randrange(5, 80)) for _ in range(160)]
    for k in range(0, 40):
        texts[k] += " idiot scum loser moron trash"
    base = prose(rng, 90)
    texts += [base, base, base.upper(), base + " one more", prose(rng, 20) + " " + passage, passage, "", None, "x", None]
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}", 1) for k, t in enumerate(texts)]
    rows += [rows[100], rows[100], (None, texts[101], None, None, None), (None, None, None, None, None)]
    labels = [(k, 1, int(k < 40)) for k in range(0, 160)]
    return rows, labels, [(1, passage), (2, None), (3, "")]


def key(r):
    return r.doc_id, r.text


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, labels, items = corpus()
    write_tables(spark, folder, rows, labels, items)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def after(name, given):
        done = steps[name](spark, given, folder)
        done.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    clean = after("toxicity", docs)
    scored = score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert Counter(map(key, clean.collect())) == Counter(key(r) for r in scored if not r.predicted)
    assert clean.columns == docs.columns
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert len(lost & set(range(40))) >= 36 and len(lost - set(range(40))) <= 4

    single = after("ngram_jaccard", clean)
    given = [key(r) for r in clean.collect()]
    reps = {i for i, n, c in brute_components(given) if n and i == c}
    got = Counter(map(key, single.collect()))
    assert {i for (i, t) in got if spelled_set(t)} == reps and single.columns == docs.columns
    assert all(got[k] == n for k, n in Counter(given).items() if not spelled_set(k[1]))
    assert all(n == 1 for (i, t), n in got.items() if spelled_set(t))

    pure = after("decontamination", single)
    item = spelled_set(items[0][1])
    want = {k: n for k, n in got.items() if 100 * len(item & spelled_set(k[1])) < 75 * len(item)}
    assert Counter(map(key, pure.collect())) == want and len(want) < len(got)

    mixed = after("mixing", pure)
    size = defaultdict(int)
    for r in pure.collect():
        size[r.source] += 1 + len((r.text or "").encode())
    roots = sum(math.sqrt(b) for b in size.values())
    counts = Counter(map(key, mixed.collect()))
    for r in pure.collect():
        mean = math.sqrt(size[r.source]) / roots * sum(size.values()) / size[r.source]
        name = "null" if r.doc_id is None else r.doc_id
        text = hashlib.md5((r.text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"mix:{name}:{text}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean)
        total = p
        while total <= u:
            k += 1
            p *= mean / k
            total += p
        assert counts[key(r)] == k * want[key(r)]
    assert mixed.columns == docs.columns

    dealt = steps["sharding"](spark, mixed, folder).toPandas()
    assert len(dealt) == mixed.count()
    for _, part in dealt.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert Counter(whole["doc_id"].fillna(-1)) == Counter(dealt["doc_id"].fillna(-1))


def test_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_blocks_of_hashes_are_made_in_little_memory():
    values = np.random.default_rng(7).integers(0, 2**64, 300_000, dtype=np.uint64)
    tracemalloc.start()
    made = 0
    for bucket, blob in setjoin._low_halves(values, 50):
        own = values[(values >> np.uint64(32)) % np.uint64(50) == bucket] if bucket % 17 == 0 else None
        made += len(blob) // 4
        if own is not None:
            assert blob == np.sort(own.astype(np.uint32)).tobytes()
    assert made == len(values)
    assert list(setjoin._low_halves(values[:0], 50)) == []
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    assert sum(len(blob) for _, blob in setjoin._low_halves(values, 50)) == 4 * len(values)
    assert tracemalloc.get_traced_memory()[1] - before < 2.5 * values.nbytes
    tracemalloc.stop()


def test_scores_are_made_without_pandas_in_the_workers():
    assert "pd" not in vars(toxicity)
