"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant turns in alternation,
beginning with user and ending with assistant. An illegal one is repaired: a turn may be kept, merged
into the turn before it, relabelled, or preceded by empty turns. Dynamic programming over the
automaton of legal turns finds the cheapest repair.

Turns are dealt to ranges of conversation and order and numbered by their place; a conversation is cut
into pieces of at most ``2 ** PIECE_BITS`` neighbouring rows, whatever their turn numbers are, so turns
without a number, turns that share one and all rows without a conversation are cut, too. Every piece gives the cheapest cost from
each state of the automaton to each other; these small tables are combined along the conversation,
and then every piece is repaired for the states it is known to begin and end in. So a conversation
that holds a third of all turns is repaired by many tasks, and only its tables meet in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilspark.operators.staging import stage

PIECE_BITS = 10

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
#: Which turns may follow a state; a conversation may end in START or ASSISTANT.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INFINITE = float("inf")


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    insert: int = 2


def fillers(state: int, role: int) -> tuple[int, ...] | None:
    """Fewest empty turns after ``state`` that let ``role`` follow; None if it never can."""
    paths: list[tuple[int, tuple[int, ...]]] = [(state, ())]
    seen = {state}
    while paths:
        at, path = paths.pop(0)
        if role in NEXT[at]:
            return path
        for other in NEXT[at]:
            if other not in seen:
                seen.add(other)
                paths.append((other, (*path, other)))
    return None


def ending(state: int) -> tuple[int, ...]:
    """Empty turns that end a conversation legally."""
    return () if state in (START, ASSISTANT) else (*fillers(state, ASSISTANT), ASSISTANT)


@lru_cache(maxsize=64)
def moves(state: int, role: int, costs: Costs) -> tuple[tuple[int, int, str, tuple[int, ...]], ...]:
    """For each state a turn can lead to, the cheapest (state, cost, action, empty turns before it).

    ``role`` 0 is any unknown or missing role. Ties go to keep, then merge, relabel, insert.
    """
    found: dict[int, tuple] = {}
    options = []
    if state != START:
        own = role == state
        options.append((costs.merge + (0 if own else costs.relabel), 1, state, "merge" if own else "merge_relabel", ()))
    for new in (SYSTEM, USER, ASSISTANT):
        path = fillers(state, new)
        if path is not None:
            own = role == new
            name = ("keep" if own else "relabel") if not path else ("insert" if own else "insert_relabel")
            rank = 0 if name == "keep" else 2 if name == "relabel" else 3
            options.append((costs.insert * len(path) + (0 if own else costs.relabel), rank, new, name, path))
    for cost, _, new, name, path in sorted(options):
        found.setdefault(new, (new, cost, name, path))
    return tuple(found.values())


def walk(roles: list[int], begin: int, costs: Costs) -> list[dict[int, tuple]]:
    """After each turn, per reachable state: (cost, turns made, state before, move)."""
    layer: dict[int, tuple] = {begin: (0, 0, None, None)}
    layers = [layer]
    for role in roles:
        new: dict[int, tuple] = {}
        for state in sorted(layer):
            cost, made = layer[state][:2]
            for move in moves(state, role, costs):
                total = cost + move[1]
                if move[0] not in new or total < new[move[0]][0]:
                    more = len(move[3]) + (0 if move[2].startswith("merge") else 1)
                    new[move[0]] = (total, made + more, state, move)
        layer = new
        layers.append(layer)
    return layers


def trace(layers: list[dict[int, tuple]], end: int) -> list[tuple]:
    """The moves of the cheapest way to ``end``."""
    out = []
    for layer in reversed(layers[1:]):
        _, _, end, move = layer[end]
        out.append(move)
    return out[::-1]


def _code(role: str | None) -> int:
    return ROLES.get(role, 0)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(b.column(c).to_pylist() for c in names), strict=True) for b in batches)


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded numbers of rows and of characters of text."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or chars >= 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


TABLES = pa.schema([("k", pa.string()), ("seg", pa.int64()), ("flat", pa.list_(pa.float64()))])
WAYS = pa.schema(
    [("k", pa.string()), ("seg", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("first_turn", pa.int64()),
     ("is_last", pa.bool_()), ("total", pa.int64())]
)
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _tables(costs: Costs) -> Step:
    def table(roles: list[int]) -> list[float]:
        flat = []
        for begin in range(4):
            last = walk(roles, begin, costs)[-1]
            for end in range(4):
                flat += [float(last[end][0]), float(last[end][1])] if end in last else [INFINITE, 0.0]
        return flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = groupby(_rows(batches, ["k", "seg", "role"]), key=lambda r: r[:2])
        yield from _emit(((*key, table([_code(r[2]) for r in piece])) for key, piece in pieces), TABLES)

    return run


def _ways(costs: Costs) -> Step:
    """Begin and end state, first turn number and last flag of each piece, on the cheapest way."""

    def ways(key: str, pieces: list[tuple]) -> Iterator[tuple]:
        layer: dict[int, tuple] = {START: (0.0, None)}
        layers = [layer]
        for _, _, table in pieces:
            new: dict[int, tuple] = {}
            for begin in sorted(layer):
                for end in range(4):
                    cost = layer[begin][0] + table[8 * begin + 2 * end]
                    if cost < INFINITE and (end not in new or cost < new[end][0]):
                        new[end] = (cost, begin)
            layer = new
            layers.append(layer)
        closing = {s: c[0] + costs.insert * len(ending(s)) for s, c in layer.items()}
        state = min(sorted(closing), key=closing.get)
        total, states = closing[state], [state]
        for step in reversed(layers[1:]):
            states.append(step[states[-1]][1])
        states.reverse()
        turn = 0
        for n, (_, seg, table) in enumerate(pieces):
            begin, end = states[n], states[n + 1]
            yield key, seg, begin, end, turn, n == len(pieces) - 1, int(total)
            turn += int(table[8 * begin + 2 * end + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_rows(batches, ["k", "seg", "flat"]), key=lambda r: r[0])
        yield from _emit(chain.from_iterable(ways(k, list(g)) for k, g in groups), WAYS)

    return run


def escaped(text: str) -> str:
    """The text without the marks that open a turn: ``<|`` becomes ``<\\|``, and ``<\\`` becomes ``<\\\\``."""
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def render_turn(role: int, text: str) -> str:
    return f"<|{NAMES[role]}|>\n{text}\n"


def _repairs(costs: Costs, schema: pa.Schema) -> Step:
    def repaired(piece: list[tuple]) -> Iterator[tuple]:
        *_, begin, end, turn, is_last, total = piece[0]
        chosen = trace(walk([_code(r[4]) for r in piece], begin, costs), end)
        for n, ((new, _, action, path), (_, _, conv, number, role, text, *_)) in enumerate(zip(chosen, piece, strict=True)):
            text = "" if text is None else escaped(text)
            merged = action.startswith("merge")
            turn += len(path) + (0 if merged else 1)
            done = f"{text}\n" if merged else "".join(render_turn(r, "") for r in path) + render_turn(new, text)
            if is_last and n == len(piece) - 1:
                done += "".join(render_turn(r, "") for r in ending(end))
            yield conv, number, role, action, turn - 1, NAMES[new], done, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "seg", "conv_id", "turn", "role", "text", "begin", "end", "first_turn", "is_last", "total"]
        pieces = groupby(_rows(batches, names), key=lambda r: r[:2])
        yield from _emit(chain.from_iterable(repaired(list(p)) for _, p in pieces), schema)

    return run


def repair_roles(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    costs: Costs | None = None,
) -> DataFrame:
    """``conv_id, turn, role, action, out_turn, out_role, rendered, cost``, a row for each turn.

    ``rendered`` in order of the turns, joined by nothing, is the repaired conversation: the first row
    of a turn opens it, merged rows go on, empty turns stand in front of the row that needs them or at
    the end. ``cost`` is that of the whole conversation. A text can not open a turn: its ``<|`` is
    rendered as ``<\\|``, and ``<\\`` as ``<\\\\``. Turns are ordered by number, null last, then role and text (its
    first 64 characters, then its hash). Rows that repeat all four columns are one turn. A null or unknown role costs a
    relabel; a null text is empty; a null conversation id is a conversation of its own. Other columns
    are not looked at. An empty table gives an empty table.
    """
    costs = costs or Costs()
    named = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    order = ["k", F.col("turn").asc_nulls_last(), "role", F.left("text", F.lit(64)), F.xxhash64("text")]
    dealt = named.distinct().withColumn("k", key).repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a row's range is in the upper bits, so a piece never crosses the end of a range.
    placed = stage(dealt.withColumn("place", F.monotonically_increasing_id()), "turns")
    cut = placed.withColumn("seg", F.shiftright("place", PIECE_BITS))

    def sorted_pieces(df: DataFrame) -> DataFrame:
        return df.repartition("k", "seg").sortWithinPartitions("place")

    tables = sorted_pieces(cut).select("k", "seg", "role").mapInArrow(_tables(costs), "k string, seg long, flat array<double>")
    ways = stage(
        tables.repartition("k").sortWithinPartitions("k", "seg").mapInArrow(
            _ways(costs), "k string, seg long, begin int, end int, first_turn long, is_last boolean, total long"
        ),
        "ways",
    )
    out = T.StructType([named.schema[c] for c in ("conv_id", "turn", "role")])
    for name, kind in (("action", "string"), ("out_turn", "long"), ("out_role", "string"), ("rendered", "string"), ("cost", "long")):
        out = out.add(name, kind)
    return sorted_pieces(cut.join(ways, ["k", "seg"])).mapInArrow(_repairs(costs, to_arrow_schema(out)), out)
