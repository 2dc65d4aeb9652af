"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

The legal conversations are none, or an optional system turn and then user and assistant in turn. An
automaton of four states reads them: nothing yet, after the system turn, after a user, after an
assistant. A row is one of a few symbols (its role's initial and its fault), and a symbol is a 4 x 4
matrix of least costs between states, inserted turns in front of the row included; matrices multiply
by minimum and sum. Equal symbols in a row are one run, and a run is advanced by the binary powers of
its matrix, which are computed once. The choices are unrolled afterwards, against the costs to go.

A conversation may be of any length. Rows are dealt to ranges of conversation and order, so a long
conversation is cut at the ends of ranges into segments, at most two for each end in the whole table.
Segments become matrices on their own; the few that belong to cut conversations are combined on the
driver into costs to go, and their exits into entries; then every segment is unrolled on its own.
Only the digest of a repaired conversation is read by one task, as a stream, because a digest is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.lookup import join_null_safe
from veilspark.operators.staging import stage

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
BLANKS = " \t\n\x0b\f\r"
#: Initials in the order of their codes; every other initial has code 3.
INITIALS = "sua"
OK, CUT, BLANK, REPEATED = range(4)
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more user or assistant turn, whichever is legal.
SPOKEN = (USER, USER, ASSISTANT, USER)
#: Cost of the turns that must still be inserted at the end.
CLOSING = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60

Vector = tuple[int, ...]


def kept_state(state: int, initial: int) -> int | None:
    """The state after keeping a row of that initial, or None where it is not legal."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial in (1, 2):
        said = USER if initial == 1 else ASSISTANT
        return said if SPOKEN[state] == said else None
    return None


def row_edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row, in the order of their letters."""
    initial, fault = divmod(code, 4)
    edits = [("D", DELETE, state)]
    if fault in (OK, CUT):
        more = TRUNCATED if fault == CUT else 0
        kept = kept_state(state, initial)
        if kept is not None:
            edits.append(("K", more, kept))
        edits.append(("R", REROLE + more, SPOKEN[state]))
    return edits


@lru_cache(maxsize=1 << 16)
def step_back(code: int, after: Vector) -> Vector:
    """Costs to go in front of a row from those behind it."""
    own = [min(cost + after[to] for _, cost, to in row_edits(code, q)) for q in range(4)]
    return tuple(min(own[q], INSERT + own[SPOKEN[q]], 2 * INSERT + own[SPOKEN[SPOKEN[q]]]) for q in range(4))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


UNIT = np.where(np.eye(4, dtype=bool), 0, FAR)


@cache
def doubled(code: int, k: int) -> np.ndarray:
    """The matrix of 2 to the power of ``k`` rows of one symbol."""
    if k:
        half = doubled(code, k - 1)
        return product(half, half)
    columns = [step_back(code, tuple(0 if q == to else FAR for q in range(4))) for to in range(4)]
    return np.minimum(np.array(columns, dtype=np.int64).T, FAR)


def run_matrix(code: int, length: int) -> np.ndarray:
    out, k = UNIT, 0
    while length:
        if length & 1:
            out = product(out, doubled(code, k))
        length, k = length >> 1, k + 1
    return out


def runs_of(symbols: np.ndarray) -> list[tuple[int, int]]:
    """(symbol, length) of the runs. Rows that must go are one symbol, whatever their role."""
    plain = np.where(symbols % 4 >= BLANK, BLANK, symbols)
    edges = np.flatnonzero(np.concatenate(([True], plain[1:] != plain[:-1], [True])))
    return list(zip(plain[edges[:-1]].tolist(), np.diff(edges).tolist()))


def segment_matrix(symbols: np.ndarray) -> np.ndarray:
    out = UNIT
    for code, length in runs_of(symbols):
        out = product(out, run_matrix(code, length))
    return out


def through(matrix: np.ndarray, after: Vector) -> Vector:
    return tuple(np.minimum((matrix + np.array(after, dtype=np.int64)[None, :]).min(axis=1), FAR).tolist())


def unroll(symbols: np.ndarray, after: Vector, entries: Sequence[int], last: bool) -> list[tuple[str, int, int]]:
    """For each entry state the cheapest edits' letters, least in ASCII order, the exit state and the cost to go."""
    runs = runs_of(symbols)
    behind = [after]  # costs to go behind each run, from the last one
    for code, length in reversed(runs):
        behind.append(through(run_matrix(code, length), behind[-1]))
    front = behind.pop()
    states, letters = list(entries), [[] for _ in entries]
    for (code, length), to_go in zip(runs, reversed(behind)):
        costs = [to_go]
        for _ in range(length):
            costs.append(step_back(code, costs[-1]))
        for k, q in enumerate(states):
            for i in range(length, 0, -1):
                here, then = costs[i], costs[i - 1]
                while True:
                    delete, *others = row_edits(code, q)
                    if delete[1] + then[q] == here[q]:
                        letters[k].append("D")
                        break
                    if INSERT + here[SPOKEN[q]] == here[q]:
                        letters[k].append("I")
                        q = SPOKEN[q]
                        continue
                    letter, _, q = next(e for e in others if e[1] + then[e[2]] == here[q])
                    letters[k].append(letter)
                    break
            states[k] = q
    out = []
    for k, q in enumerate(states):
        while last and q not in (START, ASSISTANT):
            letters[k].append("I")
            q = SPOKEN[q]
        out.append(("".join(letters[k]), q, front[entries[k]]))
    return out


# --- rows and symbols -------------------------------------------------------------------------------


def ordered_rows(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``place, conv, turn, role, text, code`` with a place that rises with conversation and order.

    Equal turns are ordered by role and by the text's first 64 characters and hash. The last key only
    parts rows that are equal, so that a range never has to hold all copies of one row.
    """
    plain = rows.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    keyed = plain.withColumns(
        {"__head": F.left("text", F.lit(64)), "__hash": F.xxhash64("text"), "__copy": F.monotonically_increasing_id()}
    )
    order = ["conv", "turn", "role", "__head", "__hash", "__copy"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    end = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(end == "", F.lit(BLANK)).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), F.lit(CUT)).otherwise(OK)
    )
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    placed = dealt.withColumns({"place": F.monotonically_increasing_id(), "code": initial * 4 + fault})
    return placed.select("place", "conv", "turn", "role", "text", "code")


def symbols_of(ordered: DataFrame) -> DataFrame:
    """``range, place, conv, code``: rows whose role and text stood earlier are marked as repeated."""
    firsts = (
        ordered.groupBy("conv", "role", F.sha2("text", 256).alias("digest"))
        .agg(F.min("place").alias("place"))
        .select("place", F.lit(True).alias("first"))
    )
    small = ordered.select("place", "conv", "code").join(firsts, "place", "left")
    repeated = F.col("first").isNull() & (F.col("code") % 4 != BLANK)
    code = F.when(repeated, F.col("code") - F.col("code") % 4 + REPEATED).otherwise(F.col("code"))
    return small.select(F.shiftright("place", 33).alias("range"), "place", "conv", code.cast("byte").alias("code"))


def _segments(
    batches: Iterator[pa.RecordBatch], extra: Sequence[str] = ()
) -> Iterator[tuple[object, np.ndarray, np.ndarray, dict]]:
    """(conversation, places, codes, extra values) of each segment, from rows in order of place."""

    def grown(parts):
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    key, parts, more = None, [], {}
    for batch in batches:
        conv, ranges = batch.column("conv"), batch.column("range").to_numpy()
        places, codes = batch.column("place").to_numpy(), batch.column("code").to_numpy().astype(np.int64)
        names = conv.to_pylist()
        cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1] or ranges[i] != ranges[i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(names)]):
            if lo == hi:
                continue
            at = (names[lo], int(ranges[lo]))
            if parts and at != key:
                yield key[0], *grown(parts), more
                parts = []
            if not parts:
                key, more = at, {c: batch.column(c)[lo].as_py() for c in extra}
            parts.append((places[lo:hi], codes[lo:hi]))
    if parts:
        yield key[0], *grown(parts), more


def _blocks(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block = []
    if block:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def _arrow(conv: pa.DataType, **fields: pa.DataType) -> pa.Schema:
    return pa.schema([("conv", conv), *fields.items()])


def _illegal(first: int, second: int) -> bool:
    return (first, second) not in ((0, 1), (1, 2), (2, 1))


def _summaries(conv: pa.DataType) -> Callable:
    schema = _arrow(conv, seg=pa.int64(), range=pa.int64(), matrix=pa.list_(pa.int64()), counts=pa.list_(pa.int64()),
                    illegal=pa.int64(), first=pa.int32(), last=pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, places, codes, _ in _segments(batches):
                initials, faults = codes // 4, np.bincount(codes % 4, minlength=4)
                pairs = initials[:-1] * 4 + initials[1:]
                legal = np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]).sum()
                yield (
                    name, int(places[0]), int(places[0]) >> 33, segment_matrix(codes).reshape(-1).tolist(),
                    faults.tolist(), len(pairs) - int(legal), int(initials[0]), int(initials[-1]),
                )

        yield from _blocks(rows(), schema)

    return run


def _unrolled(conv: pa.DataType, exits: bool) -> Callable:
    """Audits of the segments, or the exit states of each for all four entries."""
    fields = {"exits": pa.list_(pa.int32())} if exits else {"audit": pa.string(), "cost": pa.int64()}
    schema = _arrow(conv, seg=pa.int64(), **fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, places, codes, known in _segments(batches, ("after", "entry", "last")):
                after = tuple(known["after"] or CLOSING)
                last = known["last"] is not False
                if exits:
                    found = unroll(codes, after, range(4), last)
                    yield name, int(places[0]), [q for _, q, _ in found]
                else:
                    audit, _, cost = unroll(codes, after, [known["entry"] or START], last)[0]
                    yield name, int(places[0]), audit, cost

        yield from _blocks(rows(), schema)

    return run


def _combined(cut: list) -> tuple[dict[int, tuple[Vector, bool]], dict[object, int]]:
    """For each segment of the cut conversations its costs to go and whether it is the last; illegal
    pairs across segments by conversation."""
    after, between = {}, {}
    for name, group in groupby(cut, key=lambda r: r["conv"]):
        rows, to_go = list(group), CLOSING
        for i, row in enumerate(reversed(rows)):
            after[row["seg"]] = (to_go, i == 0)
            to_go = through(np.array(row["matrix"], dtype=np.int64).reshape(4, 4), to_go)
        between[name] = sum(_illegal(a["last"], b["first"]) for a, b in zip(rows, rows[1:]))
    return after, between


def _by_range(symbols: DataFrame) -> DataFrame:
    return symbols.repartition("range").sortWithinPartitions("range", "place")


@dataclass(frozen=True)
class Repair:
    """``conversations``: ``conv, blank, duplicate, truncated, illegal, cost, audit``. ``messages`` and
    ``digests`` read the rows again and play the audits."""

    ordered: DataFrame
    audits: DataFrame
    conversations: DataFrame

    def _stream(self) -> DataFrame:
        rows = self.ordered.select("conv", "place", F.lit(1).alias("kind"), "role", "text")
        none = F.lit(None).cast("string")
        heads = self.audits.select(
            "conv", F.col("seg").alias("place"), F.lit(0).alias("kind"), none.alias("role"), F.col("audit").alias("text")
        )
        return rows.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "place", "kind")

    def messages(self) -> DataFrame:
        """``conv, number, edit, role, text``: the repaired conversations, numbered from 1."""
        kind = self.ordered.schema["conv"].dataType.simpleString()
        return self._stream().mapInArrow(_played(False), f"conv {kind}, number long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """``conv, sha256``: of the repaired ``role:text``, joined by newlines, in UTF-8."""
        kind = self.ordered.schema["conv"].dataType.simpleString()
        return self._stream().mapInArrow(_played(True), f"conv {kind}, sha256 string")


def _played(digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def repaired():
            """(conversation, edit, role, text) in order; edit None at the start of a conversation."""
            nonlocal schema
            name, started, state, audit, at = None, False, START, "", 0

            def inserted():
                nonlocal state, at
                while at < len(audit) and audit[at] == "I":
                    state, at = SPOKEN[state], at + 1
                    yield name, "I", "user" if state == USER else "assistant", ""

            for batch in batches:
                own = batch.schema.field("conv").type
                schema = schema or (
                    _arrow(own, sha256=pa.string()) if digest
                    else _arrow(own, number=pa.int64(), edit=pa.string(), role=pa.string(), text=pa.string())
                )
                columns = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))
                for conv, kind, role, text in zip(*columns):
                    if kind == 0:
                        if not started or conv != name:
                            name, started, state = conv, True, START
                            yield name, None, None, None
                        audit, at = text, 0
                        yield from inserted()
                        continue
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = SYSTEM if role[:1] == "s" else SPOKEN[state]
                        yield name, edit, role, text
                    elif edit == "R":
                        state = SPOKEN[state]
                        yield name, edit, "user" if state == USER else "assistant", text
                    yield from inserted()

        def digests():
            hasher = name = None
            empty = True
            for conv, edit, role, text in repaired():
                if edit is None:
                    if hasher:
                        yield name, hasher.hexdigest()
                    name, hasher, empty = conv, hashlib.sha256(), True
                    continue
                hasher.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "replace"))
                empty = False
            if hasher:
                yield name, hasher.hexdigest()

        def numbered():
            number = 0
            for conv, edit, role, text in repaired():
                number = 0 if edit is None else number + 1
                if edit:
                    yield conv, number, edit, role, text

        rows = digests() if digest else numbered()
        first = next(rows, None)
        if first is not None:

            def all_rows():
                yield first
                yield from rows

            yield from _blocks(all_rows(), schema, 500)

    return run


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """Find faults and the cheapest legal form of every conversation.

    A row's first fault counts: ``blank`` (nothing but blanks and control characters from tab to
    carriage return), ``duplicate`` (role and text stood earlier in the conversation), ``truncated``
    (the last other character is not one of ``.!?``). Keeping a row costs 0, giving it the role user or
    assistant 1, deleting it 2, and a truncated row that stays 5 more; blank and duplicate rows must go;
    an empty user or assistant turn can be inserted anywhere for 5. ``audit`` holds the letters D, I, K,
    R of the cheapest edits in order; of several, the least in ASCII order. ``illegal`` counts
    neighbouring rows whose initials are not su, ua or au.

    Rows are taken by turn, null turns first; equal turns by role, then by text (its first 64 characters,
    then its hash); equal rows may be taken in any order. Null roles and texts are one blank. Rows with a
    null conversation id are one conversation. Empty tables have no conversations. Other columns are
    not carried, so their names can not clash.
    """
    ordered = stage(ordered_rows(rows, conv_id, turn, role, text), "ordered")
    symbols = stage(symbols_of(ordered), "symbols")
    kind = ordered.schema["conv"].dataType
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind.simpleString()]
    name = f"conv {kind.simpleString()}, seg long"
    segments = stage(
        _by_range(symbols).mapInArrow(
            _summaries(arrow),
            f"{name}, range long, matrix array<long>, counts array<long>, illegal long, first int, last int",
        ),
        "segments",
    )
    several = segments.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    # At most two segments for each end of a range; ids and numbers only.
    cut = join_null_safe(segments, several, ["conv"]).orderBy("seg").collect()
    after, between = _combined(cut)
    spark = rows.sparkSession
    shape = f"range long, conv {kind.simpleString()}, after array<long>, entry int, last boolean"

    def known(entries: dict[int, int]) -> DataFrame:
        table = [(r["range"], r["conv"], list(after[r["seg"]][0]), entries.get(r["seg"]), after[r["seg"]][1]) for r in cut]
        return F.broadcast(spark.createDataFrame(table, shape))

    entries: dict[int, int] = {}
    if cut:
        inside = join_null_safe(symbols, known({}), ["range", "conv"])
        exits = _by_range(inside).mapInArrow(_unrolled(arrow, True), f"{name}, exits array<int>")
        leaves = {r["seg"]: r["exits"] for r in exits.collect()}  # as many as ``cut``
        for _, group in groupby(cut, key=lambda r: r["conv"]):
            state = START
            for r in group:
                entries[r["seg"]] = state
                state = leaves[r["seg"]][state]
    informed = join_null_safe(symbols, known(entries), ["range", "conv"], "left")
    audits = stage(_by_range(informed).mapInArrow(_unrolled(arrow, False), f"{name}, audit string, cost long"), "audits")

    seams = spark.createDataFrame(list(between.items()), f"conv {kind.simpleString()}, seams long")
    counted = segments.groupBy("conv").agg(
        F.sum(F.get("counts", F.lit(BLANK))).alias("blank"),
        F.sum(F.get("counts", F.lit(REPEATED))).alias("duplicate"),
        F.sum(F.get("counts", F.lit(CUT))).alias("truncated"),
        F.sum("illegal").alias("illegal"),
    )
    whole = join_null_safe(counted, F.broadcast(seams), ["conv"], "left")
    joined = audits.groupBy("conv").agg(
        F.min_by("cost", "seg").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )
    conversations = join_null_safe(
        whole.withColumn("illegal", F.col("illegal") + F.coalesce("seams", F.lit(0))).drop("seams"), joined, ["conv"]
    )
    return Repair(ordered, audits, conversations)
