"""Word shingle sets joined by Jaccard resemblance: a size-aware heavy-light join.

Two sets link at a threshold on the Jaccard resemblance of their distinct shingles. All shingles have
one order, rare ones first, so two linked sets share a shingle among the first ones of each. Shingles
that stand in one set only come first of all and need no list; a bitmap tells them. Above a size boundary the first shingles are the inverted lists to scan. Up to the boundary sets enumerate
subsets of two of their first shingles instead; linked small sets share a subset, and strangers
rarely do. A cost model over the sizes of all sets picks the boundary.

Equal sets are one node. A list of up to ``SMALL_LIST`` nodes gives all its pairs. A longer one first
gives only a chain and stars around its most central nodes, those whose shingles stand in most sets,
since the original of many copies is central and copies need not resemble each other. Once these are
verified, the list gives the pairs whose ends are not yet connected. Near copies thus seldom expand
into all pairs, and every link between components is tested.

Python sees numbers only in packed arrays: one row is a block of one bucket of hashes, so shuffles
move few large rows. Buckets are sized from the bytes of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.components import components
from veilspark.llm.hashing import mix, shingle_set, signature
from veilspark.operators.lookup import join_hot
from veilspark.operators.staging import stage

PERCENT = 75
SMALL_LIST = 16
CENTRES = 2
#: Values that a task gathers before it writes blocks, and bytes of text a bucket stands for.
FLUSH = 2_000_000
BUCKET_BYTES = 16 << 20
MIN_BUCKETS = 16
#: Shingles in at least ``LEAST_COUNT`` sets may be ordered by their count; the most frequent
#: ``MAX_FREQUENT`` of them are broadcast (16 bytes each), all others count as rare.
LEAST_COUNT = 4
MAX_FREQUENT = 500_000
#: Bits of the bitmap of shingles in several sets for each byte of text, and its largest size.
BIT_SHARE = 8
MIN_BITS, MAX_BITS = 1 << 17, 1 << 28
#: Residues by which texts of candidates are picked before the exact join, a bounded broadcast.
RESIDUES = 1 << 20
PAIRS_PER_BATCH = 200_000
#: A subset key names two shingles, so its lists are shorter than a shingle's; cost of a pair in postings.
PAIR_COST = 8.0

_SUBSET = np.uint64(1)


def least_overlap(size: int, percent: int) -> int:
    """Fewest shingles that a set of this size shares with any linked set."""
    return max(1, -(-size * percent // 100))


def first_count(size: int, percent: int) -> int:
    return size - least_overlap(size, percent) + 1


def _blocks(bucket_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket_of, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket_of[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket_of[part[0]]), part


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _low_halves(values: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Buckets of hashes with the sorted lower halves of their values. One array is sorted in place, which
    takes a third of the memory of an order and what it picks."""
    key = values >> np.uint64(32)
    key %= np.uint64(buckets)
    key <<= np.uint64(32)
    key |= values & np.uint64(0xFFFFFFFF)
    key.sort()
    ends = np.searchsorted(key, np.arange(1, buckets + 1, dtype=np.uint64) << np.uint64(32))
    start = 0
    for bucket, end in enumerate(ends.tolist()):
        if end > start:
            yield bucket, key[start:end].astype(np.uint32).tobytes()
        start = end


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for text in batch.column("text"):
        yield text.as_py() or ""


def _sets_pass(buckets: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per text: ``row, th, n_shingles, sig``. Besides, blocks of the hashes of its sets to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            values = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
            held.clear()
            seen.clear()
            parts = _low_halves(values, buckets)
            while some := list(islice(parts, 64)):
                rows, blobs = map(list, zip(*some, strict=True))
                none = [None] * len(rows)
                yield pa.record_batch(
                    [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
                     pa.array(none, pa.binary()), pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())],
                    names=["row", "th", "n_shingles", "sig", "bucket", "blob"],
                )

        size = 0
        for batch in batches:
            counts, sigs = [], []
            for text in _texts(batch):
                values = shingle_set(text, n)
                sig = signature(values)
                counts.append(len(values))
                sigs.append(sig)
                if len(values) and sig not in seen:
                    seen.add(sig)
                    held.append(values)
                    size += len(values)
                    if size >= FLUSH:
                        yield from flush()
                        size = 0
            none = [None] * len(counts)
            yield pa.record_batch(
                [batch.column("row"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                names=["row", "th", "n_shingles", "sig", "bucket", "blob"],
            )
        yield from flush()

    return run


def _bit(low: np.ndarray, bits: int) -> np.ndarray:
    return (mix(low.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _count_bucket(table: pa.Table, bits: int) -> pa.Table:
    """Shingles of a bucket with their numbers of sets; in the row without key, sums over all of them
    and the bits of those in several sets."""
    bucket = table.column("bucket")[0].as_py()
    values = np.sort(np.concatenate([np.frombuffer(b.as_py(), dtype=np.uint32) for b in table.column("blob")]))
    cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    counts = np.diff(cuts)
    keep = counts >= LEAST_COUNT
    keys = (np.int64(bucket) << 32) | values[cuts[:-1]][keep].astype(np.int64)
    rare = counts[~keep & (counts > 1)]
    known = np.zeros(bits, dtype=bool)
    known[_bit(values[cuts[:-1]][counts > 1], bits)] = True
    none = [None] * len(keys)
    return pa.table(
        {
            "bucket": pa.array([*none, bucket], pa.int32()),
            "bits": pa.array([*none, np.packbits(known).tobytes()], pa.binary()),
            "key": pa.array([*keys.tolist(), None], pa.int64()),
            "count": pa.array([*counts[keep].tolist(), None], pa.int64()),
            "total": pa.array([*none, int(rare.sum())], pa.int64()),
            "squares": pa.array([*none, int((rare * rare).sum())], pa.int64()),
        }
    )


def choose_boundary(sizes: Sequence[tuple[int, int]], partners: float, percent: int) -> int:
    """Largest size of a set that enumerates subsets, by estimated cost.

    ``sizes`` holds (size, number of sets). A first shingle costs a posting and its ``partners``, a
    subset costs a posting. Sets above ``percent`` of the boundary are in the inverted lists too,
    where larger sets look for them.
    """
    best, chosen = None, 0
    for boundary in (0, *(1 << k for k in range(2, 9))):
        cost = 0.0
        for size, sets in sizes:
            first = first_count(size, percent)
            if size <= boundary:
                cost += sets * (first + 1) * first / 2
            if size * 100 > boundary * percent:
                cost += sets * first * (1 + PAIR_COST * partners)
        if best is None or cost < best:
            best, chosen = cost, boundary
    return chosen


def _keys(values: np.ndarray, counts: np.ndarray, percent: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists that a set belongs to, and the places in its order of their (last) shingle.

    The lowest bit of a key tells subsets from single shingles.
    """
    size = len(values)
    first = first_count(size, percent)
    order = np.lexsort((values, counts))[: first + 1]
    keys, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    if size * 100 > boundary * percent:
        place = np.flatnonzero(counts[order[:first]] > 1)
        keys.append(mix(values[order[place]]) & ~_SUBSET)
        places.append(place)
    if size <= boundary:
        place = np.flatnonzero(counts[order] > 1)
        ordered = values[order[place]]
        i, j = np.triu_indices(len(ordered), 1)
        low, high = np.minimum(ordered[i], ordered[j]), np.maximum(ordered[i], ordered[j])
        keys.append(mix(low * np.uint64(0x9E3779B97F4A7C15) + high) | _SUBSET)
        places.append(place[j])
    return np.concatenate(keys), np.concatenate(places)


def _lists_pass(order, buckets: int, bits: int, percent: int, boundary: int, n: int):
    """Blocks of postings: keys, places of their sets, and the sets' signatures and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, known, known_counts = order.value
        keys: list[np.ndarray] = []
        ranks: list[np.ndarray] = []
        sets: list[tuple[bytes, int, int]] = []
        seen: set[bytes] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                key, rank = np.concatenate(keys), np.concatenate(ranks).astype(np.uint32)
                place = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                sig = np.frombuffer(b"".join(s for s, *_ in sets), dtype="V16")
                size = np.array([m for _, m, _ in sets], dtype=np.uint32)
                central = np.array([m for *_, m in sets], dtype=np.uint32)
                for bucket, part in _blocks(_bucket(key, buckets)):
                    own, where = np.unique(place[part], return_inverse=True)
                    yield pa.record_batch(
                        [pa.array([bucket], pa.int32()), pa.array([key[part].tobytes()], pa.binary()),
                         pa.array([where.astype(np.uint32).tobytes()], pa.binary()),
                         pa.array([sig[own].tobytes()], pa.binary()), pa.array([size[own].tobytes()], pa.binary()),
                         pa.array([central[own].tobytes()], pa.binary()), pa.array([rank[part].tobytes()], pa.binary())],
                        names=["bucket", "keys", "places", "sigs", "sizes", "central", "ranks"],
                    )
            keys.clear()
            ranks.clear()
            sets.clear()
            seen.clear()

        gathered = 0
        for batch in batches:
            for text in _texts(batch):
                values = shingle_set(text, n)
                sig = signature(values)
                if len(values) < 2 or sig in seen:
                    continue
                seen.add(sig)
                bucket, bit = _bucket(values, buckets), _bit(values.astype(np.uint32), bits)
                counts = 1 + ((several[bucket, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(np.int64)
                if int((counts == 1).sum()) >= first_count(len(values), percent):
                    continue  # the first ones stand in no other set
                if len(known):
                    short = (bucket << 32) | values.astype(np.uint32).astype(np.int64)
                    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                    counts = np.where(known[at] == short, known_counts[at], counts)
                made, rank = _keys(values, counts, percent, boundary)
                if not len(made):
                    continue
                ranks.append(rank)
                sets.append((sig, len(values), int(1000 * np.log2(counts).mean())))
                keys.append(made)
                gathered += len(made)
                if gathered >= FLUSH:
                    yield from flush()
                    gathered = 0
        yield from flush()

    return run


def _may_link(size_a, rank_a, size_b, rank_b, single, percent: int) -> np.ndarray:
    """Whether two sets can link whose first common shingle, or second of a subset, has these places.

    Of two linked sets each misses only so many shingles of the other, and in the common order their
    first common shingle stands no later than that in either.
    """
    least = -(-percent * (size_a + size_b) // (100 + percent))
    late = np.where(single, 0, 1)
    return (rank_a <= size_a - least + late) & (rank_b <= size_b - least + late)


def _scan_bucket(percent: int, boundary: int) -> Callable[[pa.Table], pa.Table]:
    """Scan the lists of a bucket: pairs to verify, and the members of long lists."""

    def run(table: pa.Table) -> pa.Table:
        def column(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(b.as_py(), dtype=kind) for b in table.column(name)]

        sigs, keys = column("sigs", "V16"), np.concatenate(column("keys", np.uint64))
        starts = np.cumsum([0] + [len(s) for s in sigs])[:-1]
        places = np.concatenate([p + s for p, s in zip(column("places", np.uint32), starts, strict=True)])
        names, first, inverse = np.unique(np.concatenate(sigs), return_index=True, return_inverse=True)
        size = np.concatenate(column("sizes", np.uint32)).astype(np.int64)[first]
        central = np.concatenate(column("central", np.uint32)).astype(np.int64)[first]
        node = inverse.reshape(-1)[places]
        rank = np.concatenate(column("ranks", np.uint32)).astype(np.int64)
        order = np.lexsort((node, size[node], keys))
        keys, node, rank = keys[order], node[order], rank[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])))
        keys, node, rank = keys[new], node[new], rank[new]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        length = np.diff(cuts)
        left, right, long_lists = [], [], []  # places in the arrays above
        for m in range(2, SMALL_LIST + 1):
            at = cuts[:-1][length == m]
            if len(at):
                i, j = np.triu_indices(m, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
        for at, end in zip(cuts[:-1][length > SMALL_LIST], cuts[1:][length > SMALL_LIST], strict=True):
            members = np.arange(at, end)
            left.append(members[:-1])
            right.append(members[1:])
            for centre in members[np.lexsort((node[members], -central[node[members]]))[:CENTRES]]:
                left.append(np.full(len(members), centre))
                right.append(members)
            long_lists.append((at, end))
        i = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
        j = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
        x, y = node[i], node[j]
        single = (keys[i] & _SUBSET) == 0
        ok = _may_link(size[x], rank[i], size[y], rank[j], single, percent) & (x != y)
        ok &= ~(single & (size[x] <= boundary) & (size[y] <= boundary))
        pairs = np.unique(np.minimum(x[ok], y[ok]) * len(names) + np.maximum(x[ok], y[ok]))
        x, y = pairs // max(1, len(names)), pairs % max(1, len(names))
        rows = np.concatenate([np.arange(s, e) for s, e in long_lists]) if long_lists else np.zeros(0, dtype=np.int64)
        some = [names[k].tobytes() for k in range(len(names))] if len(x) or len(rows) else []
        more, none = len(rows), len(pairs)
        return pa.table(
            {
                "a": pa.array([some[k] for k in x] + [some[k] for k in node[rows]], pa.binary()),
                "b": pa.array([some[k] for k in y] + [None] * more, pa.binary()),
                "key": pa.array([None] * none + keys[rows].view(np.int64).tolist(), pa.int64()),
                "size": pa.array([None] * none + size[node[rows]].tolist(), pa.int64()),
                "rank": pa.array([None] * none + rank[rows].tolist(), pa.int64()),
            }
        )

    return run


def _cross_bucket(percent: int, boundary: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of long lists whose ends are in different components. Rows come sorted by key."""

    def pairs_of(key: int, sigs: list[bytes], size: np.ndarray, rank: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        single = not key & 1
        for i in range(len(sigs) - 1):
            other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            ok = _may_link(size[other], rank[other], size[i], rank[i], single, percent)
            if single:
                ok &= ~((size[other] <= boundary) & (size[i] <= boundary))
            other = other[ok]
            if len(other):
                a, b = [min(sigs[i], sigs[j]) for j in other], [max(sigs[i], sigs[j]) for j in other]
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                sigs, sizes, ranks, names = zip(*held, strict=True)
                _, label = np.unique(np.array(names, dtype="V16"), return_inverse=True)
                yield from pairs_of(current, list(sigs), np.array(sizes), np.array(ranks), label)

        for batch in batches:
            for key, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "size", "rank", "label"))):
                if key != current:
                    yield from close()
                    current, held = key, []
                held.append(tuple(member))
        yield from close()

    return run


def _set_blobs(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[bytes, bytes] = {}
            for text in _texts(batch):
                values = shingle_set(text, n)
                made.setdefault(signature(values), values.tobytes())
            yield pa.record_batch(
                [pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.binary())], names=["sig", "blob"]
            )

    return run


def _verify(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def linked(x: bytes, y: bytes) -> bool:
        u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        small, large = (u, v) if len(u) <= len(v) else (v, u)
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        shared = int((large[at] == small).sum())
        return 100 * shared >= percent * (len(u) + len(v) - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(x.as_py(), y.as_py()) for x, y in zip(batch.column("blob_a"), batch.column("blob_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, n: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) that link. Sets are made anew, for the candidates' texts only."""
    pairs = stage(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    texts_of = ends.join(nodes.select("sig", "th"), "sig")
    residue = F.pmod("th", F.lit(RESIDUES)).alias("residue")
    wanted = stage(texts_of.select("sig", "th", residue), "wanted")
    near = docs.select("text", "th", residue).join(
        F.broadcast(wanted.select("residue").distinct()), "residue", "left_semi"
    )
    made = near.select("text").mapInArrow(_set_blobs(n), "sig binary, blob binary")
    blobs = stage(made.groupBy("sig").agg(F.first("blob").alias("blob")).join(ends, "sig", "left_semi"), "sets")
    with_a = pairs.join(blobs.select(F.col("sig").alias("a"), F.col("blob").alias("blob_a")), "a")
    with_b = with_a.join(blobs.select(F.col("sig").alias("b"), F.col("blob").alias("blob_b")), "b")
    return stage(with_b.mapInArrow(_verify(percent), "a binary, b binary"), "links")


def _order_of(spark: SparkSession, counted: DataFrame, buckets: int, bits: int):
    """What the order of shingles needs: the bitmap of those in several sets, and keys and counts of
    the most frequent, sorted by key, at most ``MAX_FREQUENT`` of them."""
    counts = counted.where("key is not null").withColumn("step", F.floor(F.log2("count")))
    step, kept = 64, 0
    by_step = counts.groupBy("step").agg(F.count("*").alias("n")).collect()
    for s, n in sorted(((r["step"], r["n"]) for r in by_step), reverse=True):
        if kept + n > MAX_FREQUENT:
            break
        step, kept = s, kept + n
    rows = counts.where(F.col("step") >= step).select("key", "count").toPandas().sort_values("key")
    several = np.zeros((buckets, bits // 8), dtype=np.uint8)
    for row in counted.where("bits is not null").select("bucket", "bits").toLocalIterator():
        several[row["bucket"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast((several, rows["key"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)))


def similar_sets(docs: DataFrame, ids: Sequence[str] = ("doc_id",), text: str = "text", percent: int = PERCENT, n: int = 5) -> DataFrame:
    """``ids, n_shingles, component`` for every row; equal ``component`` for rows connected by links.

    The set of a text is its distinct ``n``-word shingles; a text with fewer words has one, all its
    words; null, empty and blank texts have none and a null ``component``, and link with nothing.
    Equal texts, so also repeated rows, link. Null ids are kept. Other columns are not looked at.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(*ids, t.alias("text"), F.xxhash64(t).alias("th"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, ceil(total / BUCKET_BYTES))
    # Of one bucket; all buckets together stay below the largest size.
    bits = max(8, max(MIN_BITS, min(MAX_BITS, total // BIT_SHARE)) // buckets // 8 * 8)
    work = named.withColumn("row", F.monotonically_increasing_id())
    made = stage(
        work.select("row", "th", "text").mapInArrow(
            _sets_pass(buckets, n), "row long, th long, n_shingles long, sig binary, bucket int, blob binary"
        ),
        "shingles",
    )
    per_text = made.where("bucket is null").select("th", "n_shingles", "sig")
    nodes = stage(
        per_text.groupBy("sig").agg(F.min("th").alias("th"), F.first("n_shingles").alias("size"), F.count("*").alias("n")),
        "nodes",
    )
    counted = stage(
        made.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(
            lambda table: _count_bucket(table, bits),
            "bucket int, bits binary, key long, count long, total long, squares long",
        ),
        "counts",
    )
    sums = counted.agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).first()
    partners = (sums["squares"] or 0) / max(1, sums["total"] or 0) - 1
    by_size = nodes.where("size > 1").groupBy(F.least("size", F.lit(1024)).cast("int").alias("s")).agg(F.count("*").alias("k"))
    boundary = choose_boundary([(r["s"], r["k"]) for r in by_size.collect()], max(0.0, partners), percent)
    order = _order_of(spark, counted, buckets, bits)
    lists = work.select("text").mapInArrow(
        _lists_pass(order, buckets, bits, percent, boundary, n),
        "bucket int, keys binary, places binary, sigs binary, sizes binary, central binary, ranks binary",
    )
    scanned = stage(
        lists.groupBy("bucket").applyInArrow(_scan_bucket(percent, boundary), "a binary, b binary, key long, size long, rank long"),
        "scanned",
    )
    links = _links(named, nodes, scanned.where("b is not null").select("a", "b"), percent, n)
    labels = components(links)
    long_lists = scanned.where("b is null").select("key", "a", "size", "rank")
    if not long_lists.isEmpty():
        told = long_lists.join(labels, long_lists["a"] == labels["node"], "left")
        told = stage(told.select("key", "a", "size", "rank", F.coalesce("label", "a").alias("label")), "long")
        split = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        open_lists = told.join(split.select("key"), "key", "left_semi").repartition("key").sortWithinPartitions("key")
        cross = open_lists.mapInArrow(_cross_bucket(percent, boundary), "a binary, b binary")
        links = links.unionByName(_links(named, nodes, cross, percent, n))
        labels = components(links)
    labelled = nodes.join(labels, nodes["sig"] == labels["node"], "left").select(
        "sig", F.coalesce("label", "sig").alias("component"), "n"
    )
    rows = named.select(*ids, "th")
    known = per_text.groupBy("th").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("m"))
    by_text = stage(
        join_hot(known, stage(labelled, "labelled"), ["sig"], "n").select(
            "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"), "m"
        ),
        "texts",
    )
    return join_hot(rows, by_text, ["th"], "m")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, component``: the smallest id that links reach from each row.

    A row without shingles has its own id. Null ids do not count as smallest unless all are null.
    """
    rows = stage(similar_sets(docs, [doc_id], text, percent, n), "similar")
    least = rows.where("component is not null").groupBy("component")
    least = stage(least.agg(F.min(doc_id).alias("component_id"), F.count("*").alias("n")), "least")
    linked = join_hot(rows.where("component is not null"), least, ["component"], "n")
    alone = rows.where("component is null").withColumn("component_id", F.col(doc_id))
    return linked.unionByName(alone).select(doc_id, "n_shingles", "component_id", "component", "th")


def keep_one_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = 5, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Rows of ``docs``, all columns: of connected ones only the row with the smallest id stays.

    Rows without shingles all stay. Of rows that repeat the staying row's id, one stays. The removed
    rows are broadcast up to ``broadcast_rows`` of them (about 20 bytes each) and joined beyond.
    """
    rows = similar_documents(docs, doc_id, text, percent, n)
    rows = stage(rows.where("component is not null").select(doc_id, "th", "component", "component_id"), "kept")
    first = rows.where(F.col(doc_id).eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min("th").alias("__th"), F.count("*").alias("__n")
    )
    # Only rows of components with a second row can go.
    several = rows.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    many = rows.join(several.select("component"), "component", "left_semi")
    judged = many.join(first, "component", "left").withColumn(
        "stays", F.col(doc_id).eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("__th"))
    )
    judged = stage(judged.select(F.col(doc_id).alias("__id"), F.col("th").alias("__t"), "stays", "__n"), "judged")
    gone = judged.where(~F.col("stays")).select("__id", "__t").distinct()
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (key == F.col("__t"))
    kept = docs.join(gone, same, "left_anti")
    repeated = judged.where(F.col("stays") & (F.col("__n") > 1)).select("__id", "__t").distinct()
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(repeated, same, "left_anti").unionByName(again)
