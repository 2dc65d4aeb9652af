"""Dictionaries too large for one regex: whole-word terms.

A whole-word term starts and ends at the borders of word runs. A dictionary of up to
``AUTOMATON_BYTES`` becomes an automaton (a trie with failure links) in every task, and a text is read
once, in its place, whatever the number of terms. A larger one is joined: runs of words of a text, with
the separators between them, are candidates and meet the dictionary by equality. If that is still of a
checked size the join is a broadcast, words that start no term are dropped first, candidates have only
the lengths that terms with their first word have, and only matches are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.hof import empty, once, running
from veilspark.functions.kinds import SPANS
from veilspark.functions.spans import place, span
from veilspark.operators.lookup import join_hot
from veilspark.operators.staging import stage

WORD = r"\w+"
#: Words of the longest term allowed. Candidates per word of a text are at most so many.
LONGEST = 32
BROADCAST_TERMS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: An automaton takes some fifty bytes for each byte of its terms.
AUTOMATON_BYTES = 2 << 20

_HITS = "array<struct<start:int,end:int,value:string>>"
_WORD_CHAR = re.compile(WORD, re.ASCII)
_automata: dict[tuple, ahocorasick.Automaton] = {}


def _automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    """The terms' automaton, kept by a Python worker for its next tasks."""
    if terms not in _automata:
        made = ahocorasick.Automaton()
        for term, ord_ in terms:
            made.add_word(term, (ord_, len(term)))
        made.make_automaton()
        _automata.clear()
        _automata[terms] = made
    return _automata[terms]


def _lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _scan(terms: tuple[tuple[str, int], ...], ignore_case: bool) -> Callable[[pa.Array], pa.Array]:
    def whole(text: str, start: int, end: int) -> bool:
        return not (start and _WORD_CHAR.match(text, start - 1)) and not (end < len(text) and _WORD_CHAR.match(text, end))

    def run(texts: pa.Array) -> pa.Array:
        find, out = _automaton(terms), []
        for t in texts:
            text = t.as_py() or ""
            # An automaton without terms can not be asked.
            found = find.iter(_lowered(text) if ignore_case else text) if terms else ()
            hits = [(e + 1 - n, o, -n) for e, (o, n) in found]
            kept, last = [], 0
            for start, _, size in sorted(h for h in hits if whole(text, h[0], h[0] - h[2])):
                if start >= last:
                    last = start - size
                    kept.append({"start": start, "end": last, "value": text[start:last]})
            out.append(kept)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])))

    return run


def _positions(longest: int) -> Column:
    """One struct per word: its start, and the words and separators its longest candidate needs."""
    return F.transform(
        "__w",
        lambda w, i: F.struct(
            F.get("__s", i)["start"].alias("start"),
            w.alias("first"),
            F.slice("__w", i + 1, F.lit(longest)).alias("w"),
            F.slice("__g", i + 2, F.lit(longest - 1)).alias("g") if longest > 1 else F.array().cast("array<string>").alias("g"),
        ),
    )


def _candidates(lengths: Column) -> Column:
    """Runs of words from the start of a position, of the lengths given."""
    return F.transform(
        F.filter(lengths, lambda k: k <= F.size("w")),
        lambda k: F.array_join(
            F.zip_with(
                F.concat(F.array(F.lit("")), F.slice("g", F.lit(1), k - 1)),
                F.slice("w", F.lit(1), k),
                lambda sep, word: F.concat(sep, word),
            ),
            "",
        ),
    )


def term_spans(
    texts: DataFrame,
    ids: Sequence[str],
    terms: DataFrame,
    label: str,
    text: str = "text",
    ignore_case: bool = False,
    rank: int = 0,
    out: str = "term_spans",
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """``ids, out``: spans of the whole-word occurrences of the terms, for texts with at least one.

    ``terms`` has a column ``term`` and optionally an integer ``ord``. Matches in one text do not
    overlap: the leftmost wins, then the lowest ``ord``, then the longest. Terms that do not start
    and end with a word character have no whole-word form here and fail the job, as do terms of more
    than ``LONGEST`` words; use a rule for those. Null terms are ignored. ``ids`` identify a text; with a
    dictionary above ``automaton_bytes`` texts that share ids share a row.
    """
    ids = list(ids)
    fold = F.lower if ignore_case else (lambda c: c)
    order = F.min("ord") if "ord" in terms.columns else F.lit(0)
    whole = F.col("term").rlike(r"^\w(?:[\s\S]*\w)?\z") & (F.regexp_count("term", F.lit(WORD)) <= LONGEST)
    refused = F.raise_error(F.concat(F.lit("not a whole-word term: "), F.col("term"))).cast("string")
    known = (
        terms.where(F.col("term").isNotNull())
        .withColumn("__term", F.when(whole, fold(F.col("term"))).otherwise(refused))
        .groupBy("__term")
        .agg(order.cast("int").alias("__ord"))
    )
    size = known.agg(
        F.max(F.regexp_count("__term", F.lit(WORD))), F.count("*"), F.sum(F.octet_length("__term"))
    ).first()
    if (size[2] or 0) <= automaton_bytes:
        listed = tuple((r["__term"], r["__ord"]) for r in known.orderBy("__term").collect())
        if ignore_case:
            listed = tuple(sorted({_lowered(t): o for t, o in reversed(listed)}.items()))
        scan = F.arrow_udf(_scan(listed, ignore_case), _HITS)
        hit = once(texts.where(F.col(text).isNotNull()).select(*ids, text), "__hits", scan(F.col(text)))
        kind, named, ranked = F.lit("CUSTOM"), F.lit(label), F.lit(rank)
        spans = F.transform("__hits", lambda h: span(kind, h["start"], h["end"], h["value"], named, ranked))
        return hit.where(F.size("__hits") > 0).select(*ids, spans.alias(out))
    longest = size[0] or 1
    small = size[1] <= BROADCAST_TERMS and (size[2] or 0) <= BROADCAST_BYTES

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    cut = texts.select(*ids, words.alias("__w"), F.split(text, WORD, -1).alias("__g")).where(F.size("__w") > 0)
    null, zero = F.lit(None), F.lit(0)
    located = cut.withColumn(
        "__s",
        place(
            F.col("__w"),
            F.col("__w"),
            F.col("__g"),
            lambda start, end, v: span(F.lit("CUSTOM"), start, end, v, null, zero),
        ),
    )
    positions = located.select(*ids, F.explode(_positions(longest)).alias("c")).select(
        *ids, "c.start", fold(F.col("c.first")).alias("__first"), "c.w", "c.g"
    )
    lengths = F.sequence(F.lit(1), F.size("w"))
    if small:
        # Most words start no term; they are dropped before any candidate is built.
        words_of = F.regexp_count("__term", F.lit(WORD))
        first = known.groupBy(F.regexp_extract("__term", WORD, 0).alias("__first")).agg(F.collect_set(words_of).alias("__n"))
        positions = positions.join(F.broadcast(first), "__first")
        lengths = F.col("__n")
    found = positions.select(*ids, "start", F.explode(_candidates(lengths)).alias("value")).withColumns(
        {"end": F.col("start") + F.length("value"), "__term": fold(F.col("value"))}
    )
    if small:
        hits = found.join(F.broadcast(known), "__term")
    else:
        used = found.groupBy("__term").agg(F.count("*").alias("__n")).join(known, "__term")
        hits = join_hot(found, stage(used, "terms"), ["__term"], "__n")

    ordered = F.sort_array(
        F.collect_list(
            F.struct("start", F.col("__ord").alias("ord"), (-F.col("end")).alias("neg_end"), "end", "value")
        )
    )

    def step(last_end: Column, h: Column) -> tuple[Column, Column]:
        free = h["start"] >= last_end
        one = span(F.lit("CUSTOM"), h["start"], h["end"], h["value"], F.lit(label), F.lit(rank))
        return F.when(free, h["end"]).otherwise(last_end), F.when(free, F.array(one)).otherwise(empty(SPANS))

    grouped = hits.groupBy(*ids).agg(ordered.alias("__hits"))
    return grouped.select(*ids, running(F.col("__hits"), F.lit(-1), step, SPANS).alias(out))
