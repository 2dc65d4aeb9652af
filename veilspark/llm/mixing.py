"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean number of repetitions so that its expected bytes match its target weight. A
uniform number made from the seed, the document id and a digest of the text is put through the inverse
of the Poisson distribution of that mean; the document is repeated so many times and the copies are
dealt to partitions and ordered by a second hash. The digest tells documents apart that share an id or
have none. How often a document comes depends on ids, texts, weights and seed alone, not on partitions
or retries.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.hof import once
from veilspark.operators.staging import stage

#: Largest mean that one inversion handles; a larger mean is a sum of several.
MAX_MEAN = 256.0
#: Sources up to this number are broadcast (a row holds about 100 numbers).
MAX_BROADCAST = 20_000
SALTS = 64

UNIT = 4_503_599_627_370_496  # 2 ** 52, the range of 13 hexadecimal digits


def uniform(seed: Column | str, *keys: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of seed and keys; nulls are spelled ``null``."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, str) else seed, *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(UNIT))


def repetition_rates(
    docs: DataFrame, source: str, size: Column, weights: Mapping[str, float] | None, power: float
) -> DataFrame:
    """``source, n_docs, bytes, weight, rate`` over all rows. Weights sum to 1; a mean of 1 keeps a source.

    Without ``weights`` the weight of a source is proportional to its bytes to the ``power``. With
    them, sources not named have weight 0 and null is named ``null``.
    """
    totals = docs.groupBy(F.col(source).alias("__source")).agg(
        F.count("*").alias("n_docs"), F.sum(size).alias("bytes")
    )
    if weights is None:
        raw = F.pow(F.col("bytes").cast("double"), F.lit(float(power)))
    else:
        names = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map()
        raw = F.coalesce(names[F.coalesce(F.col("__source"), F.lit("null"))].cast("double"), F.lit(0.0))
    weighed = stage(totals.withColumn("__raw", raw), "sources")
    whole = weighed.agg(F.sum("__raw").alias("raw"), F.sum("bytes").alias("bytes")).first()
    every, size_of_all = F.lit(float(whole["raw"] or 0)), F.lit(float(whole["bytes"] or 0))
    rate = F.try_divide(F.col("__raw") / every * size_of_all, F.col("bytes"))
    return weighed.select(
        "__source",
        "n_docs",
        "bytes",
        F.try_divide("__raw", every).alias("weight"),
        F.when(every > 0, F.coalesce(rate, F.lit(0.0))).otherwise(F.lit(0.0)).alias("rate"),
    )


def with_inverse(rates: DataFrame) -> DataFrame:
    """Add ``pieces`` and ``cdf``: the mean is split evenly into pieces of at most ``MAX_MEAN``, and
    ``cdf`` holds the distribution of a piece from 0 up to where it is 1 in double precision."""
    mean = F.col("rate") / F.col("pieces")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf"),
        ),
    )
    split = rates.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int"))
    return split.withColumn("cdf", step["cdf"])


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    seed: str = "mix",
) -> DataFrame:
    """Repeat every row of ``docs`` a Poisson number of times and shuffle all copies.

    Adds ``n_copies``, ``copy`` (from 1), ``rate`` and ``shuffle_key``, replacing columns of these
    names; all other columns are kept. A row drawn zero times is left out: that is the sampling.
    Sizes are UTF-8 bytes plus 1, so null and empty texts count as 1 and no source has size 0. Null is
    a source of its own. Rows that share an id draw by their texts; only rows with equal id and text draw
    the same number. Null ids draw as ``null``; their copies are ordered by their place in the input, too,
    so that many equal rows without an id do not meet in one partition. An empty table gives an empty
    table.
    """
    docs = docs.drop("n_copies", "copy", "rate", "shuffle_key")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rates = stage(with_inverse(repetition_rates(docs, source, size, weights, power)), "rates")
    wanted = rates.select(
        "__source", F.col("rate").alias("__rate"), F.col("pieces").alias("__pieces"), F.col("cdf").alias("__cdf")
    )
    if rates.count() <= MAX_BROADCAST:
        joined = docs.join(F.broadcast(wanted), F.col(source).eqNullSafe(F.col("__source")))
    else:
        # Too many sources to broadcast: a hot source is spread over salts.
        salted = wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("__dealt", F.pmod(F.xxhash64(doc_id, text), F.lit(SALTS)).cast("int"))
        same = F.col(source).eqNullSafe(F.col("__source")) & (F.col("__dealt") == F.col("__salt"))
        joined = dealt.join(salted, same).drop("__salt", "__dealt")
    named = once(joined, "__text", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    named = named.withColumn("__place", F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id()))
    who = [F.col(doc_id), F.col("__text")]
    draws = F.transform(F.sequence(F.lit(1), F.col("__pieces")), lambda k: uniform(seed, *who, k))
    drawn = once(named, "__draws", draws)
    count = F.aggregate("__draws", F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u)))
    counted = once(drawn, "n_copies", count).withColumn("rate", F.col("__rate"))
    counted = counted.drop("__draws", "__cdf", "__pieces", "__rate", "__source")
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", uniform(f"{seed}-order", *who, F.col("copy"), F.col("__place")))
    dealt = keyed.drop("__text", "__place").repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key", doc_id, "copy")
