"""Byte-exact removal of repeated substrings by distributed prefix doubling.

A byte goes if some string of ``LENGTH`` bytes over it also starts in a document with a smaller id.
Sorting all positions of a corpus at every doubling would move many times its bytes, so positions are
first thinned and dealt out by their own content:

1. The anchor of a position is the smallest hash among the ``PART``-byte strings inside its ``LENGTH``
   bytes. It depends on these bytes alone, so equal strings have equal anchors. Consecutive positions
   mostly share one and form a run. Spark counts in how many documents an anchor stands; a bitmap of
   bounded size keeps those that stand in several.
2. Runs of such anchors, each with its bytes, are dealt by anchor. A block of documents keeps the bytes
   of its runs once and sends equal runs once, with the smallest document id.
3. In each bucket the positions of all runs are ranked by prefix doubling: pairs of ranks at offsets 12
   and 25 are sorted and ranked anew, positions whose rank is unique drop out, and the doubling ends
   past ``LENGTH``. Equal ranks then mean equal strings, and the smallest id of each is known.
4. Only positions whose string starts in a smaller document are answered, to the block of documents
   that asked. There the answers become spans.

Every group is a bucket or a block of bounded bytes; a passage that stands in a third of all documents
is one run for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.hashing import mix
from veilspark.operators.staging import stage

LENGTH = 50
PART = 26
WINDOW = LENGTH - PART + 1
#: Most positions in a run: with them its two outer strings cover all of its bytes.
RUN = LENGTH
#: Bytes of text that are scanned at once, and bytes of text in a block of documents.
CHUNK = 1 << 20
BLOCK = 8 << 20
#: Bytes of text for which there is a bucket; bits of the bitmap for each byte, and its largest size.
BUCKET_BYTES = 2 << 20
MIN_BUCKETS = 16
BIT_SHARE = 8
MIN_BITS, MAX_BITS = 1 << 17, 1 << 28
#: Residues of affected documents, a bounded broadcast by which the others skip the last join.
RESIDUES = 1 << 20

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
    return x


def anchors(words: np.ndarray) -> np.ndarray:
    """For each position with ``LENGTH`` bytes behind it, the smallest hash of its ``PART``-byte strings."""
    n = len(words) - (PART - 8)
    part = mix(words[:n] * _A + words[8 : n + 8] * _B + words[16 : n + 16] * _C + words[18 : n + 18] * _D)
    wide = 1
    while wide * 2 <= WINDOW:
        part = np.minimum(part[:-wide], part[wide:])
        wide *= 2
    rest = WINDOW - wide
    return np.minimum(part[:-rest], part[rest:]) if rest else part


def string_hash(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the ``LENGTH`` bytes from each of the positions ``at``."""
    out = np.full(len(at), LENGTH, dtype=np.uint64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        out = mix(out * _A + words[at + k])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start, start + count)``."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Chunk:
    """Bytes of consecutive pieces of documents, and the runs of equal anchors in them."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]) -> None:
        self.raw = b"".join(p for _, _, p in pieces)
        size = np.array([len(p) for _, _, p in pieces])
        begin = np.cumsum(size) - size
        self.words = words_of(np.frombuffer(self.raw, dtype=np.uint8))
        anchor = anchors(self.words)
        edge = np.zeros(len(anchor) + 1, dtype=bool)
        edge[1:-1] = anchor[1:] != anchor[:-1]
        edge[begin] = True
        ends = np.minimum(begin + size - LENGTH + 1, len(anchor))
        edge[ends] = True
        cuts = np.flatnonzero(edge)
        start, stop = cuts[:-1], cuts[1:]
        piece = np.searchsorted(begin, start, side="right") - 1
        inside = stop <= ends[piece]
        start, stop = start[inside], stop[inside]
        parts = -(-(stop - start) // RUN)
        at = np.repeat(start, parts) + RUN * ragged(np.zeros(len(parts), dtype=np.int64), parts)
        self.start = at
        self.count = np.minimum(np.repeat(stop, parts) - at, RUN)
        self.anchor = anchor[at]
        piece = np.searchsorted(begin, at, side="right") - 1
        self.doc = np.array([d for d, _, _ in pieces])[piece]
        self.place = at - begin[piece] + np.array([o for _, o, _ in pieces])[piece]


def pieces_of(number: int, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """A document's bytes in pieces of at most ``CHUNK``; every position has all its bytes in one."""
    for at in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
        yield number, at, raw[at : at + CHUNK + LENGTH - 1]


def _chunks(pieces: Iterator[tuple[int, int, bytes]]) -> Iterator[Chunk]:
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[2])
        if size >= CHUNK:
            yield Chunk(held)
            held, size = [], 0
    if held:
        yield Chunk(held)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _bit(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (mix(anchor.astype(np.uint32).astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _split(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(by, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(by[order])) + 1):
        if len(part):
            yield int(by[part[0]]), part


def _count_pass(buckets: int):
    """Per bucket the low bits of anchors, each once for a document and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                every = np.concatenate(held)
                held.clear()
                for bucket, part in _split(_bucket(every, buckets)):
                    blob = every[part].astype(np.uint32).tobytes()
                    yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        def pieces() -> Iterator[tuple[int, int, bytes]]:
            number = 0
            for batch in batches:
                for raw in batch.column("raw"):
                    yield from pieces_of(number, raw.as_py())
                    number += 1

        size = 0
        for chunk in _chunks(pieces()):
            order = np.lexsort((chunk.anchor, chunk.doc))
            anchor, doc = chunk.anchor[order], chunk.doc[order]
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))) if len(anchor) else []
            held.append(anchor[new] if len(anchor) else anchor)
            size += len(held[-1])
            if size >= 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _bits_of_bucket(bits: int):
    def run(table: pa.Table) -> pa.Table:
        low = np.sort(np.concatenate([np.frombuffer(b.as_py(), dtype=np.uint32) for b in table.column("blob")]))
        twice = np.unique(low[1:][low[1:] == low[:-1]])
        known = np.zeros(bits, dtype=bool)
        known[_bit(twice.astype(np.uint64), bits)] = True
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(known).tobytes()], pa.binary())})

    return run


_NAMES = ("ids", "ths", "doc", "place", "run", "count", "least", "bucket", "begin", "name", "bytes")
BLOCK_SCHEMA = "block long, " + ", ".join(f"{c} binary" for c in _NAMES)
RUNS_SCHEMA = "block long, bucket int, run binary, count binary, least binary, name binary, bytes binary"


#: Numbers that mostly grow by little are packed as steps.
_STEPS = {"ids", "doc", "place", "run", "begin"}
_KINDS = {
    "ids": np.int64, "ths": np.int64, "doc": np.uint32, "place": np.int64, "run": np.uint32, "count": np.uint8,
    "least": np.int64, "bucket": np.uint32, "begin": np.int64, "name": np.uint64, "bytes": np.uint8, "lo": np.uint8, "hi": np.uint8,
}


def _pack(name: str, values: np.ndarray) -> bytes:
    values = values.astype(_KINDS[name])
    if name in _STEPS:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _unpack(name: str, packed: bytes) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=_KINDS[name])
    return np.cumsum(values, dtype=values.dtype) if name in _STEPS else values


def _blocks_pass(repeated, buckets: int, bits: int):
    """A row for each block of documents: all places of runs, the distinct runs, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeated.value
        task = TaskContext.get().partitionId()
        serial = 0
        ids: list[int] = []
        ths: list[int] = []
        held: list[tuple[int, int, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            parts, runs, data, kept = [], [], [], 0
            for chunk in _chunks(iter(held)):
                bucket, bit = _bucket(chunk.anchor, buckets), _bit(chunk.anchor, bits)
                here = (known[bucket, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                start, count = chunk.start[here], chunk.count[here]
                name = mix(string_hash(chunk.words, start) + count.astype(np.uint64) * _B)
                name = mix(name + string_hash(chunk.words, start + count - 1))
                own, first = np.unique(name, return_index=True)
                # Neighbouring runs share their bytes.
                need = np.zeros(len(chunk.raw), dtype=bool)
                need[ragged(start[first], count[first] + LENGTH - 1)] = True
                begin = kept + (np.cumsum(need) - 1)[start[first]]
                data.append(np.frombuffer(chunk.raw, dtype=np.uint8)[need])
                kept += len(data[-1])
                runs.append((own, bucket[here][first], count[first], begin))
                parts.append((chunk.doc[here], chunk.place[here], name))
            block = task << 24 | serial
            serial += 1
            if sum(len(p[0]) for p in parts):
                doc, place, name = (np.concatenate(x) for x in zip(*parts, strict=True))
                own, bucket, count, begin = (np.concatenate(x) for x in zip(*runs, strict=True))
                names, first = np.unique(own, return_index=True)
                # Runs are numbered by place, so that numbers and places grow together.
                order = np.argsort(begin[first], kind="stable")
                number = np.empty(len(order), dtype=np.int64)
                number[order] = np.arange(len(order))
                which, first = number[np.searchsorted(names, name)], first[order]
                id_of = np.array(ids, dtype=np.int64)
                least = np.full(len(names), np.iinfo(np.int64).max)
                np.minimum.at(least, which, id_of[doc])
                values = (id_of, np.array(ths, dtype=np.int64), doc, place, which, count[first], least, bucket[first],
                          begin[first], own[first], np.concatenate(data))
                row = [pa.array([block], pa.int64())]
                row += [pa.array([_pack(c, v)], pa.binary()) for c, v in zip(_NAMES, values, strict=True)]
                yield pa.record_batch(row, names=["block", *_NAMES])
            ids.clear()
            ths.clear()
            held.clear()

        size = 0
        for batch in batches:
            for name, th, raw in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("raw")):
                raw = raw.as_py()
                held.extend(pieces_of(len(ids), raw))
                ids.append(name)
                ths.append(th)
                size += len(raw)
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


RUN_COLUMNS = ("run", "count", "least", "name", "bytes")


def _deal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and bucket a row with the runs of the bucket and their bytes."""
    for batch in batches:
        for row in batch.to_pylist():
            names = ("count", "least", "begin", "bucket", "name", "bytes")
            count, least, begin, bucket_of, name, data = (_unpack(c, row[c]) for c in names)
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for bucket, part in _split(bucket_of):
                text = data[ragged(begin[part], count[part].astype(np.int64) + LENGTH - 1)]
                packed = zip(RUN_COLUMNS, (part, count[part], least[part], name[part], text), strict=True)
                values = (bucket, *(_pack(c, v) for c, v in packed))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int32(), *[pa.binary()] * 5)
            columns = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            block = pa.array([row["block"]] * len(out[0]), pa.int64())
            yield pa.record_batch([block, *columns], names=["block", "bucket", *RUN_COLUMNS])


def rerank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the keys, and whether a rank occurs more than once."""
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, dtype=bool)
    group = np.cumsum(new) - 1
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = group
    return rank, (np.bincount(group) > 1)[rank] if len(key) else new


def doubled_ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the ``LENGTH``-byte strings at the positions ``at``; -1 where the string is unique.

    Names of 13 bytes are given; pairs of them 12 apart are sorted and ranked, then pairs of those
    ranks 25 apart. Positions whose rank is unique on the way have a unique string.
    """
    words = words_of(data)
    need = np.zeros(len(data), dtype=bool)
    need[at] = True
    need[at + 25] = True
    place = np.flatnonzero(need)
    name = lambda p: mix(words[p] * _A + words[p + 5])
    rank, shared = rerank(mix(name(place) * _B + name(place + 12)))
    at_25 = np.full(len(data), -1, dtype=np.int64)
    at_25[place] = np.where(shared, rank, -1)
    left, right = at_25[at], at_25[at + 25]
    alive = np.flatnonzero((left >= 0) & (right >= 0))
    rank, shared = rerank((left[alive].astype(np.uint64) << np.uint64(32)) | right[alive].astype(np.uint64))
    out = np.full(len(at), -1, dtype=np.int64)
    out[alive] = np.where(shared, rank, -1)
    return out


def _rank_bucket(table: pa.Table) -> pa.Table:
    """For runs of a bucket: the positions whose string starts in a document below the run's own.

    Equal runs of many blocks are one run here, so a passage in very many documents is ranked once.
    """
    counts = [_unpack("count", b.as_py()) for b in table.column("count")]
    sizes = np.array([len(c) for c in counts])
    block = np.repeat(table.column("block").to_numpy(), sizes)
    count = np.concatenate(counts).astype(np.int64)
    run, least, name = (np.concatenate([_unpack(c, b.as_py()) for b in table.column(c)]) for c in ("run", "least", "name"))
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    order = np.argsort(first)
    first, own = first[order], np.argsort(order)[which.reshape(-1)]
    parts, start = [], 0
    for b, c in zip(table.column("bytes"), counts, strict=True):
        mine = first[(first >= start) & (first < start + len(c))] - start
        length = c.astype(np.int64) + LENGTH - 1
        parts.append(_unpack("bytes", b.as_py())[ragged((np.cumsum(length) - length)[mine], length[mine])])
        start += len(c)
    wide = count[first]
    at = ragged(np.cumsum(wide + LENGTH - 1) - (wide + LENGTH - 1), wide)
    smallest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(smallest, own, least)
    owner = np.repeat(np.arange(len(first)), wide)
    rank = doubled_ranks(np.concatenate(parts), at)
    some = np.flatnonzero(rank >= 0)
    of_rank = np.full(int(rank.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(of_rank, rank[some], smallest[owner[some]])
    best = smallest[owner]
    best[some] = of_rank[rank[some]]
    # Neighbouring positions of a run with the same smallest document are one step of the answer.
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (best[1:] != best[:-1]))))
    stop = np.concatenate((new[1:], [len(owner)]))
    begin = (np.cumsum(wide) - wide)[owner[new]]
    lo, hi, low_doc = new - begin, stop - begin, best[new]
    steps = np.bincount(owner[new], minlength=len(first))
    asker = np.repeat(np.arange(len(own)), steps[own])
    step = ragged((np.cumsum(steps) - steps)[own], steps[own])
    below = low_doc[step] < least[asker]
    asker, step = asker[below], step[below]
    rows: tuple[list, ...] = ([], [], [], [], [])
    for b, part in _split(block[asker]):
        found = (run[asker[part]], lo[step[part]], hi[step[part]], low_doc[step[part]])
        values = (b, *(_pack(c, v) for c, v in zip(("run", "lo", "hi", "least"), found, strict=True)))
        for column_of, value in zip(rows, values, strict=True):
            column_of.append(value)
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table(
        [pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=["block", "run", "lo", "hi", "least"]
    )


def _spans_of_block(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """Removed spans of the documents of a block: ``id, th, removed``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out: tuple[list, ...] = ([], [], [])
    for row in asked.to_pylist():
        ids, ths = _unpack("ids", row["ids"]), _unpack("ths", row["ths"])
        doc, place, run, count = (_unpack(c, row[c]).astype(np.int64) for c in ("doc", "place", "run", "count"))
        offset = np.cumsum(count) - count
        least = np.repeat(_unpack("least", row["least"]), count)
        for answer in answers.to_pylist():
            to, lo, hi = (_unpack(c, answer[c]).astype(np.int64) for c in ("run", "lo", "hi"))
            least[ragged(offset[to] + lo, hi - lo)] = np.repeat(_unpack("least", answer["least"]), hi - lo)
        wide = count[run]
        step = ragged(np.zeros(len(run), dtype=np.int64), wide)
        owner = np.repeat(doc, wide)
        gone = least[np.repeat(offset[run], wide) + step] < ids[owner]
        at, owner = (np.repeat(place, wide) + step)[gone], owner[gone]
        order = np.lexsort((at, owner))
        at, owner = at[order], owner[order]
        if not len(at):
            continue
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (np.diff(at) > LENGTH)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)])) - 1
        for d, part in _split(owner[first]):
            out[0].append(int(ids[d]))
            out[1].append(int(ths[d]))
            out[2].append([{"start": int(s), "end": int(e)} for s, e in zip(at[first[part]], at[last[part]] + LENGTH)])
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names=["id", "th", "removed"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``id, th, removed`` of the documents that lose bytes, from rows ``id, th, raw``."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.length("raw"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, ceil(total / BUCKET_BYTES))
    # Of one bucket; all buckets together stay below the largest size.
    bits = max(8, max(MIN_BITS, min(MAX_BITS, total // BIT_SHARE)) // buckets // 8 * 8)
    counted = docs.select("raw").mapInArrow(_count_pass(buckets), "bucket int, blob binary")
    found = counted.groupBy("bucket").applyInArrow(_bits_of_bucket(bits), "bucket int, bits binary").toPandas()
    known = np.zeros((buckets, bits // 8), dtype=np.uint8)
    for bucket, row in zip(found["bucket"], found["bits"], strict=True):
        known[bucket] = np.frombuffer(row, dtype=np.uint8)
    repeated = spark.sparkContext.broadcast(known)
    blocks = stage(docs.mapInArrow(_blocks_pass(repeated, buckets, bits), BLOCK_SCHEMA), "blocks")
    runs = blocks.select("block", "count", "least", "bucket", "begin", "name", "bytes").mapInArrow(_deal_runs, RUNS_SCHEMA)
    answers = runs.groupBy("bucket").applyInArrow(
        _rank_bucket, "block long, run binary, lo binary, hi binary, least binary"
    )
    asked = blocks.select("block", "ids", "ths", "doc", "place", "run", "count", "least")
    spans = asked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _spans_of_block, "id long, th long, removed array<struct<start:bigint,end:bigint>>"
    )
    return stage(spans.dropDuplicates(["id", "th"]), "spans")


def drop_repeated_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``removed``, the byte spans taken out in order, and ``kept``, the other bytes as binary.

    ``doc_id`` is an integer. Null texts are empty; texts shorter than ``LENGTH`` bytes lose nothing.
    Rows of equal ids take nothing from each other. Rows with a null id keep all and take nothing.
    ``kept`` may end inside a character, since removal is by bytes. Columns of ``docs`` with the two
    names are replaced, others are kept. An empty table gives an empty table.
    """
    docs = docs.drop("removed", "kept")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    ranked = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), th.alias("th"), raw.alias("raw")
    )
    spans = repeated_spans(ranked)
    own: Column = F.pmod(F.xxhash64(F.col(doc_id).cast("long"), th), F.lit(RESIDUES))
    residues = F.broadcast(spans.select(F.pmod(F.xxhash64("id", "th"), F.lit(RESIDUES)).alias("__residue")).distinct())
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    plain = docs.join(residues, own.eqNullSafe(F.col("__residue")), "left_anti").withColumns({"removed": none, "kept": raw})

    @F.arrow_udf("binary")
    def rest(raws: pa.Array, spans_of: pa.Array) -> pa.Array:
        out = []
        for r, gone in zip(raws, spans_of, strict=True):
            data, at, parts = r.as_py(), 0, []
            for span in gone.as_py() or ():
                parts.append(data[at : span["start"]])
                at = span["end"]
            out.append(b"".join([*parts, data[at:]]))
        return pa.array(out, pa.binary())

    near = docs.join(residues, own.eqNullSafe(F.col("__residue")), "left_semi")
    wanted = spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "removed")
    hit = near.join(wanted, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left").drop("__id", "__th")
    cut = hit.withColumn("removed", F.coalesce("removed", none)).withColumn("kept", rest(raw, F.col("removed")))
    return plain.unionByName(cut)
