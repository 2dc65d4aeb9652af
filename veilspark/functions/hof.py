"""Small helpers over Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


_Made = TypeVar("_Made")
_built: dict[tuple, tuple[object, object]] = {}


def built(key: tuple, make: Callable[[], _Made]) -> _Made:
    """Expressions over fixed column names, built once for a Spark context and used again.

    Long expressions cost thousands of calls into the JVM, more than a small table costs to redact.
    ``key`` must name all that they depend on.
    """
    context = SparkContext._active_spark_context
    if context is None:
        return make()
    owner, found = _built.get(key, (None, None))
    if owner is not context:
        found = make()
        _built[key] = (context, found)
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that later filters on it are not pushed below it.

    Catalyst moves a filter below the projection it depends on by repeating the projected expression
    in the filter, which would run every regex twice. A one-element generator is a border such a
    filter does not cross; filters on other columns still reach the scan.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def empty(array_type: str) -> Column:
    return F.array().cast(array_type)


def lookup_all(keys: Column, entries: Column) -> Column:
    """For each of ``keys`` the value of ``entries`` (``array<struct<key,value>>``, unique keys), or null.

    Keys and entries are sorted together and every run of equal keys is answered from its head, so the
    work is that of sorting. Searching a map for each key would walk it from its start every time, which
    is cheaper for few entries only.
    """
    sought = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"), F.lit(None).cast("string").alias("v")))
    given = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), F.lit(-1).alias("i"), e["value"].alias("v")))

    def answered(m: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(m) - 1)
        heads = F.filter(places, lambda i: (i == 0) | ~F.get(m, i)["k"].eqNullSafe(F.get(m, i - 1)["k"]))

        def runs(h: Column) -> Column:
            def run(at: Column, n: Column) -> Column:
                end = F.coalesce(F.get(h, n + 1), F.size(m))
                value = F.when(F.get(m, at)["i"] == -1, F.get(m, at)["v"])
                return let(
                    F.struct(value.alias("v"), end.alias("e")),
                    lambda r: F.transform(
                        F.slice(m, at + 1, r["e"] - at), lambda x: F.struct(x["i"].alias("i"), r["v"].alias("v"))
                    ),
                )

            return F.flatten(F.transform(h, run))

        in_order = F.sort_array(F.filter(let(heads, runs), lambda x: x["i"] >= 0))
        return F.transform(in_order, lambda x: x["v"])

    def found(names: Column) -> Column:
        values = F.transform(entries, lambda e: e["value"])
        return let(values, lambda vs: F.transform(keys, lambda k: F.get(vs, F.array_position(names, k).cast("int") - 1)))

    few = (F.size(keys) > 0) & (F.size(entries) <= BLOCK)
    return (
        F.when(few, let(F.transform(entries, lambda e: e["key"]), found))
        .when(F.size(keys) > 0, let(F.sort_array(F.concat(given, sought)), answered))
        .otherwise(empty("array<string>"))
    )


def blocks(items: Column, size: int = BLOCK) -> Column:
    """Cut an array variable into consecutive arrays of at most ``size`` elements."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(size)))


def running(
    items: Column,
    state: Column,
    step: Callable[[Column, Column], tuple[Column, Column]],
    out_type: str,
) -> Column:
    """Left fold that carries ``state`` and emits an array of results per item.

    ``step(state, item)`` gives the next state and the array to emit. Results grow inside blocks of
    ``BLOCK`` items first, so a text with very many spans does not copy its whole result per span.
    """

    def inner(start: Column, block: Column) -> Column:
        def merge(acc: Column, item: Column) -> Column:
            nxt, emitted = step(acc["s"], item)
            return F.struct(nxt.alias("s"), F.concat(acc["out"], emitted).alias("out"))

        return F.aggregate(block, F.struct(start.alias("s"), empty(out_type).alias("out")), merge)

    def outer(acc: Column, block: Column) -> Column:
        return let(
            inner(acc["s"], block),
            lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], r["out"]).alias("out")),
        )

    start = F.struct(state.alias("s"), empty(out_type).alias("out"))
    return let(items, lambda xs: F.aggregate(blocks(xs), start, outer, lambda acc: acc["out"]))
