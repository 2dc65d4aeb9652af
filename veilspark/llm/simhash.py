"""Near duplicates by SimHash fingerprints, found with covering locality-sensitive hashing.

Every bit of a fingerprint carries a nonzero vector of ``radius + 1`` bits, and every nonzero vector of
that length is a table: it keeps the bits whose vectors have an odd scalar product with it. For any
``radius`` bits some table is orthogonal to all their vectors, keeps none of them, and so holds any two
fingerprints that differ in these bits only under one key. No pair within the radius is lost, and a
table keeps about half of the bits.

Equal fingerprints are one row before anything else, so copies cost nothing. A bucket of more than
``LARGE`` different fingerprints is not compared: its members agree in the kept bits, so the same
construction goes on over the bits left, which are halved at each level, until so few are left that a
bucket can hold no more than 2 to the power of them. Inside a bucket, members are linked to the first
one that reaches them, so a bucket gives fewer links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.components import components
from veilspark.operators.lookup import join_hot
from veilspark.operators.staging import stage

BITS = 64
#: A bucket of more fingerprints is cut by further tables.
LARGE = 2048
#: Shingles hashed at once, so that a very long text takes little memory.
PIECE = 1 << 15

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, n: int = 3) -> int:
    """Majority of the XXH64 (seed 42) bits of all word shingles of a text, repeats included; 0 without words.

    A-Z are lower-cased, words are parted by blanks and control characters from tab to carriage return.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    count = max(1, len(words) - n + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, count, PIECE):
        runs = (b" ".join(words[i : i + n]) for i in range(lo, min(lo + PIECE, count)))
        hashes = np.array([xxhash.xxh64_intdigest(r, 42) for r in runs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > count).tolist())


def covering_masks(bits: Sequence[int], radius: int) -> list[int]:
    """Masks over the given bit numbers, one a table, so that for any ``radius`` bits one has none of them."""
    tables = (1 << (radius + 1)) - 1
    masks = [0] * tables
    for i, bit in enumerate(bits):
        vector = i % tables + 1
        for v in range(1, tables + 1):
            if (v & vector).bit_count() % 2:
                masks[v - 1] |= 1 << bit
    return masks


def tree_links(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect what distances up to ``radius`` connect: fewer than there are fingerprints."""
    left, source, target = np.arange(len(prints)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
            reached = left[near]
            source += [at] * len(reached)
            target += reached.tolist()
            front += reached.tolist()
            left = left[~near]
    return source, target


_OUT = ["deep", "a", "b", "used"]


def _compare(radius: int, large: int):
    """Rows in order of ``used, key``: links inside buckets, and the members of large ones as ``deep`` rows.

    A bucket is large above ``large`` members, unless fewer bits are left than there are tables: then
    a table might keep none of them. Buckets are read as a stream, so what is held is a batch and a
    bucket that is not large.
    """
    tables = (1 << (radius + 1)) - 1

    def is_large(used: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (sizes > large) & (BITS - np.bitwise_count(used.view(np.uint64)) >= tables)

    def links(prints: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        close = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
        yield prints[close], prints[close + 1]
        for lo, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            group = prints[lo : lo + size]
            source, target = tree_links(group, radius)
            yield group[source], group[target]

    def record(deep: bool, a: np.ndarray, b: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
        columns = [x.view(np.int64) for x in (a, b, used)]
        return pa.record_batch([pa.array(np.full(len(a), deep)), *map(pa.array, columns)], names=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``pending`` is the bucket that the last batch ended in; ``passing`` the key of a large one.
        prints, keys = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        passing = None

        def handle(prints: np.ndarray, keys: np.ndarray, last: bool):
            nonlocal passing
            if passing is not None:
                same = (keys == passing).all(axis=1)
                n = len(keys) if same.all() else int(np.argmin(same))
                if n:
                    yield record(True, prints[:n], prints[:n], np.full(n, passing[0], np.int64))
                prints, keys = prints[n:], keys[n:]
                if len(keys):
                    passing = None
            if not len(keys):
                return prints, keys
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            sizes = np.diff(edges)
            big = is_large(np.ascontiguousarray(keys[edges[:-1], 0]), sizes)
            for lo, size in zip(edges[:-1][big].tolist(), sizes[big].tolist()):
                part = prints[lo : lo + size]
                yield record(True, part, part, np.full(size, keys[lo, 0], np.int64))
            if big[-1]:
                passing = keys[-1].copy()
            tail = 0 if last or big[-1] else int(sizes[-1])
            small = np.repeat(~big, sizes)
            small[len(keys) - tail :] = False
            for a, b in links(prints[small], keys[small]):
                if len(a):
                    yield record(False, a, b, np.zeros(len(a), np.int64))
            return prints[len(keys) - tail :], keys[len(keys) - tail :]

        for batch in batches:
            fresh = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("used", "key")], axis=1)
            prints, keys = yield from handle(np.concatenate([prints, fresh]), np.concatenate([keys, key]), False)
        yield from handle(prints, keys, True)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(used: int, radius: int) -> list[int]:
    """The bits used by each table that goes on from ``used``."""
    free = [b for b in range(BITS) if not used >> b & 1]
    return [used | m for m in covering_masks(free, radius)]


def links_within(prints: DataFrame, radius: int = 3, large: int = LARGE) -> DataFrame:
    """``a, b``: links that connect all fingerprints (distinct longs, column ``print``) within the radius.

    A pair further apart is never linked; a pair within the radius is always connected.
    """
    todo, found = prints.select("print", F.lit(0).cast("long").alias("used")), None
    parents = {0}
    while True:
        paths = {p: [_signed(t) for t in _tables(p & ((1 << BITS) - 1), radius)] for p in sorted(parents)}
        pairs = (x for p, ts in paths.items() for x in (F.lit(p).cast("long"), F.array(*map(F.lit, ts)).cast("array<long>")))
        dealt = todo.select("print", F.explode(F.element_at(F.create_map(*pairs), F.col("used"))).alias("used"))
        keyed = dealt.withColumn("key", F.col("print").bitwiseAND(F.col("used")))
        buckets = keyed.repartition("used", "key").sortWithinPartitions("used", "key")
        out = stage(buckets.mapInArrow(_compare(radius, large), "deep boolean, a long, b long, used long"), "links")
        near = out.where(~F.col("deep")).select("a", "b")
        found = near if found is None else found.unionByName(near)
        deep = out.where("deep")
        # A table number for each way of using bits: few, whatever the number of documents.
        parents = {r[0] for r in deep.select("used").distinct().collect()}
        if not parents:
            return found
        todo = deep.select(F.col("a").alias("print"), "used")


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, radius: int = 3, large: int = LARGE
) -> DataFrame:
    """Columns but the text, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id in reach.

    Two documents are linked when their fingerprints differ in at most ``radius`` bits. Null, empty and
    blank texts have the fingerprint zero and link like any other; texts with fewer than ``n`` words
    count as one shingle. Repeated rows and equal texts share a fingerprint. Null ids are never the
    smallest, unless a component has no other: then ``component_id`` is null. An empty table gives no
    rows. Columns of ``df`` with the new names are replaced; others are kept.
    """

    @F.arrow_udf("long")
    def printed(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(t.as_py(), n)) for t in texts], pa.int64())

    docs = df.drop("fingerprint", "component_id")
    marked = stage(docs.withColumn("__print", printed(F.col(text))).drop(text), "prints")
    folded = marked.groupBy("__print").agg(F.min(doc_id).alias("__least"), F.count("*").alias("__n"))
    prints = stage(folded, "distinct-prints")
    edges = links_within(prints.select(F.col("__print").alias("print")), radius, large)
    labels = components(edges).select(F.col("node").alias("__print"), F.col("label").alias("__label"))
    known = prints.join(labels, "__print", "left").withColumn("__label", F.coalesce("__label", "__print"))
    least = known.groupBy("__label").agg(F.min("__least").alias("component_id"), F.count("*").alias("__m"))
    placed = join_hot(known.select("__print", "__n", "__label"), stage(least, "components"), ["__label"], "__m")
    table = stage(placed.select("__print", "component_id", "__n"), "placed")
    joined = join_hot(marked, table, ["__print"], "__n")
    return joined.withColumn("fingerprint", _hex(F.col("__print"))).drop("__print")
