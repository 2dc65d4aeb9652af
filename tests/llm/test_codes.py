"""Vector codes against a plain computation over all entries."""

import hashlib

import numpy as np
import pytest

from veilspark.llm.codes import Slices, compress_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * scale).astype(int), lab) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    whole = np.array([v for _, v, _ in kept])
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k].tolist()))[:entries]
    cuts = np.split(whole, parts, axis=1)
    books = [c[first] for c in cuts]
    far = [((c[:, None] - b[None]) ** 2).sum(axis=2) for c, b in zip(cuts, books)]
    for _ in range(rounds):
        for p, c in enumerate(cuts):
            index = far[p].argmin(axis=1)
            books[p] = np.array([c[index == e].sum(axis=0) // (index == e).sum() if (index == e).any() else w
                                 for e, w in enumerate(books[p])])
            far[p] = ((c[:, None] - books[p][None]) ** 2).sum(axis=2)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    codes = ["".join(f"{f[k].argmin():02x}" for f in far) for k in range(len(kept))]
    errors = [int(sum(f[k].min() for f in far)) for k in range(len(kept))]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    return [(i, c, e, by_label[lab], digest) for (i, _, lab), c, e in zip(kept, codes, errors)]


def run(spark, rows, schema=SCHEMA, **options):
    done = compress_vectors(spark.createDataFrame(rows, schema).repartition(3), **options)
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r[c] for c in columns) for r in done.collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_slices_find_the_nearest_entry(spread):
    draw = np.random.default_rng(5)
    entries = np.floor(draw.normal(0, spread * 1024, (256, 6))).astype(np.int64)
    entries[200] = entries[3]  # of equal entries the first counts
    points = np.floor(draw.normal(0, spread * 1024, (1500, 6))).astype(np.int64)
    points[:256] = entries
    index, far = Slices(entries).nearest(points)
    full = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    masks = Slices(entries).candidates(points, Slices(entries).radius(points))
    assert np.bitwise_count(masks).sum(axis=1).mean() < 128


def test_codes_equal_a_plain_computation(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), draw.normal(0, 0.3, 8).astype(np.float32).tolist(), int(i % 5) if i % 7 else None)
            for i in draw.permutation(700)]
    rows += [(9000 + k, rows[0][1], 1) for k in range(300)]  # copies
    rows += [(None, rows[5][1], None), (3, rows[9][1], 2), (3, rows[9][1], 2), (9999, [-1e-9] * 8, 0)]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_unusable_vectors_are_dropped_and_small_tables_have_small_codebooks(spark):
    good = [(k, [k * 0.5, -k * 0.25, 1.0, 0.0], None) for k in range(5)]
    bad = [(90, None, 1), (91, [1.0, None, 2.0, 3.0], 1), (92, [1.0, float("nan"), 2.0, 3.0], 1),
           (93, [float("inf"), 0.0, 0.0, 0.0], 1)]
    assert run(spark, good + bad) == sorted(plain(good), key=str)
    assert run(spark, bad) == []
    assert run(spark, []) == []
    assert [r[1:3] for r in run(spark, [(1, [], 1), (2, [], 1)])] == [("00000000", 0)] * 2


def test_columns_and_refusals(spark):
    rows = [(1, [0.5, 1.0, 1.5, 2.0], 1, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", code string, n string")
    assert compress_vectors(df).columns == ["vec_id", "embedding", "label", "n", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [1.0, 2.0, 3.0], 1)])
    with pytest.raises(ValueError, match="differ in length"):
        run(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e30] * 4, 1)])
