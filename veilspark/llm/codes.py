"""Vector codes: every vector becomes one index per part into a small codebook of integer entries.

The nearest entry of a part is found by slicing and intersecting. For each dimension the entries are
kept in the order of their coordinate, with a bit mask of the entries in front of every place. A first
guess gives a radius; in each dimension the entries within that radius are one slice of the order, and
the exclusive or of its two prefix masks is their set. The sets of all dimensions, ANDed as 64-bit
words, hold every entry that can be as near as the guess, so exact distances are needed for these only.

A codebook has ``parts * entries`` rows whatever the table's size. A round is one pass over the staged
vectors: each task sums its vectors by entry, and Spark adds the sums up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.lookup import join_hot
from veilspark.operators.staging import stage

#: Integer components lie within +-LIMIT, so squared distances of parts stay inside 64 bits.
LIMIT = 1 << 26
#: Points whose candidates are measured at once.
BLOCK = 512
#: Entries around a point's place in the widest dimension that give its first radius.
GUESSES = 8


class Slices:
    """One part's codebook: entries, each dimension's sorted coordinates, and prefix masks of entries."""

    def __init__(self, entries: np.ndarray):
        size, width = entries.shape
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order
        self.sorted = np.take_along_axis(entries, order, axis=0)
        single = np.zeros((size, (size + 63) // 64), dtype=np.uint64)
        place = np.arange(size)
        single[place, place // 64] = np.uint64(1) << (place % 64).astype(np.uint64)
        self.prefix = np.zeros((width, size + 1, single.shape[1]), dtype=np.uint64)
        for d in range(width):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(single[order[:, d]], axis=0)
        spread = self.sorted[-1] - self.sorted[0] if width else np.zeros(0, np.int64)
        self.widest = int(np.argmax(spread)) if width else 0

    def radius(self, points: np.ndarray) -> np.ndarray:
        """For each point a distance within which an entry surely lies, rounded up."""
        size, count = len(self.entries), min(GUESSES, len(self.entries))
        at = np.searchsorted(self.sorted[:, self.widest], points[:, self.widest]) - count // 2
        first = np.clip(at, 0, size - count)
        best = np.full(len(points), np.iinfo(np.int64).max)
        for k in range(count):
            guess = self.entries[self.order[first + k, self.widest]]
            best = np.minimum(best, ((points - guess) ** 2).sum(axis=1))
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bit masks, one row per point, of the entries within ``radius`` in every dimension."""
        found = None
        for d in range(points.shape[1]):
            low = np.searchsorted(self.sorted[:, d], points[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], points[:, d] + radius, side="right")
            inside = self.prefix[d, high] ^ self.prefix[d, low]
            found = inside if found is None else found & inside
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to each point's nearest entry; of equal ones the lowest index."""
        index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        if not points.shape[1]:
            return index, distance
        for lo in range(0, len(points), BLOCK):
            block = points[lo : lo + BLOCK]
            masks = self.candidates(block, self.radius(block))
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            far = ((block[row] - self.entries[entry]) ** 2).sum(axis=1)
            starts = np.searchsorted(row, np.arange(len(block)))
            least = np.minimum.reduceat(far, starts)
            hits = np.flatnonzero(far == least[row])
            _, first = np.unique(row[hits], return_index=True)
            index[lo : lo + BLOCK], distance[lo : lo + BLOCK] = entry[hits[first]], least
        return index, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"vectors must all have {width} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _sums(books: list[np.ndarray]):
    """Sums of the vectors of a task by part and entry, so that a task sends at most one row for each."""
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        totals = np.zeros((parts, len(books[0]), width), dtype=np.int64)
        counts = np.zeros((parts, len(books[0])), dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * width)
            for p, s in enumerate(slices):
                points = vectors[:, p * width : (p + 1) * width]
                index, _ = s.nearest(points)
                np.add.at(totals[p], index, points)
                counts[p] += np.bincount(index, minlength=len(books[0]))
        part, entry = np.nonzero(counts)
        yield pa.record_batch(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
             pa.array(list(totals[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"],
        )

    return run


def _improved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the floored mean of its parts; entries without parts stay."""
    sums = vectors.mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
    cells = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
    added = cells.groupBy("part", "entry", "at").agg(
        F.sum(F.col("total").cast("decimal(19,0)")).alias("total"), F.sum("n").alias("n")
    )
    out = [b.copy() for b in books]
    for row in added.collect():  # at most parts * entries * width rows
        out[row["part"]][row["entry"], row["at"]] = int(row["total"]) // row["n"]
    return out


def integer_vectors(df: DataFrame, vector: str, out: str, scale: int) -> DataFrame:
    """Rows whose vector has only finite components, with ``out``: ``floor(scale * x)`` of each."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = df.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    wide = F.raise_error(F.lit(f"a vector component is beyond {LIMIT} / {scale}")).cast("long")

    def whole(x):
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LIMIT, y).otherwise(wide)

    return kept.withColumn(out, F.transform(vector, whole))


def train_codebooks(
    vectors: DataFrame, vec_id: str, vector: str, parts: int, entries: int, rounds: int
) -> list[np.ndarray]:
    """One array of integer entries for each part; none for an empty table."""
    first = vectors.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    if not first:
        return []
    width = len(first[0][0])
    if width % parts:
        raise ValueError(f"vectors of {width} components can not be cut into {parts} equal parts")
    if any(len(r[0]) != width for r in first):
        raise ValueError("vectors differ in length")
    seeds = np.array([r[0] for r in first], dtype=np.int64).reshape(len(first), width)
    books = [seeds[:, p * (width // parts) : (p + 1) * (width // parts)] for p in range(parts)]
    for _ in range(rounds if width else 0):
        books = _improved(vectors.select(vector), books)
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def compress_vectors(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """Add ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` to the rows with a usable vector.

    Rows with a null vector, or with a null or non-finite component, are dropped. Codebooks start as the
    parts of the ``entries`` smallest ids (null ids last, rows that share an id by their vector). With
    fewer rows than ``entries`` there are as many entries as rows. ``code`` holds the entries' indexes in
    hex digits, ``error`` the squared distances summed over the parts, ``label_error`` that summed over
    equal labels; null labels are equal. Repeated rows are coded alike. Vectors without components code
    as entry 0. An empty table gives no rows. Vectors of different lengths, of a length that the parts
    do not divide, or with a component beyond ``LIMIT / scale`` fail the job with a message. Columns of
    ``df`` with the new names are replaced; others are kept.
    """
    if entries > 256:
        raise ValueError("at most 256 entries")
    new = ["code", "error", "label_error", "codebooks_sha256"]
    whole = stage(integer_vectors(df.drop(*new), vector, "__whole", scale), "vectors")
    books = train_codebooks(whole, vec_id, "__whole", parts, entries, rounds)
    if not books:
        types = dict(zip(new, ("string", "long", "long", "string")))
        return whole.drop("__whole").withColumns({n: F.lit(None).cast(t) for n, t in types.items()})
    digest = codebooks_digest(books)

    @F.arrow_udf("struct<code:string,error:long>")
    def coded(vectors: pa.Array) -> pa.Array:
        values = _matrix(vectors, sum(b.shape[1] for b in books))
        width = books[0].shape[1]
        index, far = zip(*(Slices(b).nearest(values[:, p * width : (p + 1) * width]) for p, b in enumerate(books)))
        codes = np.stack(index, axis=1).astype(np.uint8)
        return pa.StructArray.from_arrays(
            [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(far), pa.int64())],
            names=["code", "error"],
        )

    done = whole.withColumn("__c", coded(F.col("__whole"))).select(
        *(c for c in whole.columns if c != "__whole"), F.col("__c.code").alias("code"), F.col("__c.error").alias("error")
    )
    done = stage(done, "codes")
    totals = done.groupBy(label).agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    joined = join_hot(done, stage(totals, "labels"), [label], "__n")
    return joined.withColumn("codebooks_sha256", F.lit(digest))
