"""Toxicity by compression distance: two zstandard dictionaries and the lengths they give to windows.

A text is read as words, a word as an 8-byte code of all its letters in lower case, and a window as
the codes of consecutive words. Each window is compressed with the dictionary of toxic text and with
the one of ordinary text; the difference of the two lengths is its gain. Codes have no accidental
matches, so a gain comes only from words that the toxic dictionary knows and the other does not.

Both dictionaries hold the same frequent codes at their end. In front the toxic one holds the codes
that mark toxic text: those found so many times as often in it as in ordinary text, on more evidence
than random labels give. The other one holds equally many codes that no text has, so that a known
word of a window is never set off by an ordinary word beside it. Equal sizes and equal ends keep the
gain of an ordinary window at zero.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.hashing import mix, powers

#: Bounds of the labelled sample that the model is fitted on: rows and bytes of a class.
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 1 << 24

#: Lengths of the overlapping pieces that a run of a dense script is cut into, in code points.
GRAMS = (2, 4)
#: Code points hashed at a time.
BLOCK = 1 << 20
WINDOW = 32
COMMON = 512
#: A marking code stands in so many toxic texts at least, and so many times as often as in ordinary ones.
LEAST = 3
RATIO = 8.0
#: Share of marking codes that may be chance; as many of them as a dictionary of 64 KiB holds.
FALSE_WORDS = 0.2
MARKS = 8_192 - COMMON
FOLDS = 10
DEALS = 4
#: Gains of a window, in bytes, whose rate among ordinary windows is calibrated.
#: A known word saves five to seven bytes wherever it stands, so a level is one word more.
LEVELS = range(1, 41, 8)
DECAY = 0.2

#: Separator, letter of a word, or code point of a script that may do without blanks.
_GAP, _LETTER, _DENSE = range(3)
_POINTS = 0x110000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its kind and a random-looking value.

    Letters, digits and marks below U+0E00, and Latin and Greek of U+1E00 to U+1FFF, make words. ASCII
    signs, punctuation, blanks and controls part them. All else is dense: scripts from Thai upwards
    with Chinese, Japanese and Korean, and symbols.
    """
    first = [unicodedata.category(chr(k))[0] for k in range(_POINTS)]
    kind = np.full(_POINTS, _DENSE, dtype=np.uint8)
    point, first = np.arange(_POINTS), np.array(first)
    kind[np.isin(first, ["P", "Z", "C"]) & ~((point >= 0xE000) & (point <= 0xF8FF))] = _GAP
    kind[(first == "S") & (point < 128)] = _GAP
    kind[np.isin(first, ["L", "M", "N"]) & ((point < 0x0E00) | (point >> 9 == 0x1E00 >> 9))] = _LETTER
    return kind, mix(point.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25))


def _spans(starts: np.ndarray, ends: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as they are; of each dense run all pieces of GRAMS code points, of a run of one itself."""
    if not dense.any():
        return starts, ends
    long = dense & (ends - starts > 1)
    length = (ends - starts)[long]
    at = np.arange(length.sum()) + np.repeat(starts[long] - (np.cumsum(length) - length), length)
    stop = np.repeat(ends[long], length)
    s, e = [starts[~long]], [ends[~long]]
    for n in GRAMS:
        s.append(at[at + n <= stop])
        e.append(s[-1] + n)
    s, e = np.concatenate(s), np.concatenate(e)
    order = np.lexsort((e, s))
    return s[order], e[order]


def codes(text: str) -> np.ndarray:
    """One 64-bit code for each word, of all its letters, and for each piece of a dense run."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds, values = _tables()
    kind = kinds[points]
    edges = np.flatnonzero(np.concatenate(([_GAP], kind)) != np.concatenate((kind, [_GAP])))
    keep = kind[edges[:-1]] != _GAP
    starts, ends = edges[:-1][keep], edges[1:][keep]
    out, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(starts):  # in blocks of whole runs, to bound the memory of long texts
        base = starts[at]
        upto = int(np.searchsorted(starts, base + BLOCK))
        part = points[base : ends[upto - 1]]
        up, down = powers(1 << max(16, len(part).bit_length()))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        s, e = _spans(starts[at:upto] - base, ends[at:upto] - base, kind[starts[at:upto]] == _DENSE)
        out.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        at = upto
    return np.concatenate(out)


#: Opens every window and ends both dictionaries; its start also ends a window, as no match begins in
#: the last eight bytes, so the last word would never be seen. Without it a block that saves only a few bytes is
#: stored as it is, and the gain of a single known word in a window of unknown ones would be lost.
HEAD = np.random.default_rng(0).bytes(64)


@dataclass(frozen=True)
class Model:
    """Dictionaries, the calibrated tail of ordinary gains, and the weights that turn hits into a score."""

    toxic: bytes
    ordinary: bytes
    tail: tuple[float, ...]
    weights: tuple[float, ...]


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=17, hash_log=17, search_log=5, min_match=6, target_length=0,
        strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=data)


def gains(text: str, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """For each window of the whole text: bytes that the toxic dictionary saves over the other."""
    raw = codes(text).tobytes()
    windows = [HEAD + raw[i : i + 8 * WINDOW] + HEAD[:16] for i in range(0, len(raw), 8 * WINDOW)]
    plain, marked = _compressor(ordinary), _compressor(toxic)
    return np.array([len(plain.compress(w)) - len(marked.compress(w)) for w in windows], dtype=np.int64)


def _tail(plain: np.ndarray) -> np.ndarray:
    """Share of ordinary windows with a gain of each of ``LEVELS`` or more; never zero.

    Where none were seen, it falls by DECAY for each level.
    """
    share: list[float] = []
    for g in LEVELS:
        seen = int((plain >= g).sum())
        least = (seen + 0.5) / (len(plain) + 1)
        share.append(least if seen or not share else min(least, share[-1] * DECAY))
    return np.array(share)


def _features(gain: np.ndarray, tail: np.ndarray) -> list[float]:
    """Evidence that the windows of a text are not ordinary, at the level of gain that shows most.

    Hits are compared with the number expected among so many ordinary windows, so a few false ones
    in a very long text weigh nothing: the Chernoff bound of a Poisson count.
    """
    hits = np.array([(gain >= g).sum() for g in LEVELS], dtype=float)
    expected = tail * max(len(gain), 1)
    surplus = np.where(hits > expected, hits * np.log(np.maximum(hits, 1) / expected) - hits + expected, 0.0)
    return [1.0, float(np.log1p(surplus.max()))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression of weighted rows by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class _Counts:
    """In how many distinct texts of each class and fold every code stands.

    Near copies would make their own words look typical of a class, so only one of the texts that
    share their two smallest codes of word pairs counts. Near copies are in one fold.
    """

    def __init__(self, texts: Sequence[str], labels: Sequence[int]) -> None:
        seen: set[tuple] = set()
        folds, single, sets = [], [], []
        for text, label in zip(texts, labels, strict=True):
            c = codes(text)
            pairs = np.unique(c[:-1] * np.uint64(31) + c[1:])
            key = tuple(pairs[:2].tolist()) or tuple(c.tolist())
            folds.append(key[0] % FOLDS if key else 0)
            if (int(label), key) not in seen:
                seen.add((int(label), key))
                single.append((int(label), folds[-1]))
                sets.append(np.unique(c))
        self.folds = np.array(folds)
        self.labels, self.fold = np.array(single, dtype=np.int64).reshape(-1, 2).T
        self.row = np.repeat(np.arange(len(sets)), [len(c) for c in sets])
        self.codes, self.place = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_inverse=True)

    def found(self, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts with each code, texts) of ordinary and of toxic texts among ``rows``."""
        counts = np.zeros((2, len(self.codes)), dtype=np.int64)
        for k in (0, 1):
            counts[k] = np.bincount(self.place[(rows & (labels == k))[self.row]], minlength=len(self.codes))
        return counts, np.array([(rows & (labels == k)).sum() for k in (0, 1)])

    def dictionaries(self, without: int | None = None) -> tuple[bytes, bytes]:
        """The toxic and the ordinary dictionary, of all folds but one."""
        rows = self.fold != without if without is not None else np.ones(len(self.fold), dtype=bool)
        counts, n = self.found(self.labels, rows)
        rng, random = np.random.default_rng(0), []
        for _ in range(DEALS):
            dealt = self.labels.copy()
            dealt[rows] = rng.permutation(self.labels[rows])
            random.append(self.found(dealt, rows)[0])
        toxic = self.codes[_marks(counts, np.hstack(random), n)]
        ranked = self.codes[np.lexsort((self.codes, -counts[0]))]
        shared = ranked[~np.isin(ranked, toxic)][:COMMON]
        unknown = np.frombuffer(np.random.default_rng(1).bytes(8 * max(len(toxic), 1)), dtype=np.uint64)
        front = toxic if len(toxic) else unknown

        def dictionary(front: np.ndarray) -> bytes:
            # The most frequent codes come last, where a reference to them is shortest.
            return np.concatenate((front[::-1], shared[::-1])).tobytes() + HEAD

        return dictionary(front), dictionary(unknown)


def _evidence(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio that a code stands more often in toxic texts; 0 for too few or too even."""
    other, own = counts
    total = counts.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(np.where(c > 0, c * np.log(c * n.sum() / (total * m)), 0.0) for c, m in zip(counts, n, strict=True))
    often = (own >= LEAST) & ((own + 0.5) / (n[1] + 1) >= RATIO * (other + 0.5) / (n[0] + 1))
    return np.where(often, gain, 0.0)


def _marks(counts: np.ndarray, random: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the codes that mark toxic texts, most evidence first, as many as the dictionary holds.

    How often a code stands in them does not matter, only that it is not chance: the evidence is cut
    where, with labels dealt at random, FALSE_WORDS as many codes would pass.
    """
    evidence = _evidence(counts, n)
    ranked = np.argsort(-evidence, kind="stable")[: int((evidence > 0).sum())]
    chance = np.sort(_evidence(random, n))
    passed = (len(chance) - np.searchsorted(chance, evidence[ranked])) / DEALS
    good = np.flatnonzero(passed <= FALSE_WORDS * np.arange(1, len(ranked) + 1))
    return ranked[: good[-1] + 1 if len(good) else 0][:MARKS]


def fit(texts: Sequence[str], labels: Sequence[int], known: Sequence[int] | None = None) -> Model | None:
    """Fit on a bounded sample of labelled texts. None without texts of both classes.

    ``known`` has how many labels of class 0 and 1 the sample stands for; each class weighs by that.

    Gains that calibrate the model are those of dictionaries made without the text's own fold, so
    words of a single text do not look like evidence.
    """
    y = np.array(labels, dtype=float)
    if not (y == 0).any() or not (y == 1).any():
        return None
    counts = _Counts(texts, labels)
    gain: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    for fold in np.unique(counts.folds):
        a, b = counts.dictionaries(without=fold)
        for i in np.flatnonzero(counts.folds == fold):
            gain[i] = gains(texts[i], a, b)
    plain = np.concatenate([g for g, label in zip(gain, labels, strict=True) if not label])
    tail = _tail(plain)
    rows = np.array([(y == 0).sum(), (y == 1).sum()])
    share = np.array(known if known is not None else rows) / rows
    weight = share[y.astype(int)] * len(y) / (share * rows).sum()
    weights = _logistic(np.array([_features(g, tail) for g in gain]), y, weight)
    return Model(*counts.dictionaries(), tuple(tail.tolist()), tuple(float(w) for w in weights))


def score_text(text: str, model: Model) -> float:
    z = float(np.dot(model.weights, _features(gains(text, model.toxic, model.ordinary), np.array(model.tail))))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity(text: Column, model: Model | None) -> Column:
    """Score of each whole text, 0 to 1. Null counts as empty; without a model every score is 0."""
    if model is None:
        return F.lit(0.0)

    # Texts are taken from Arrow one by one: as a whole batch of Python strings beside it they, and pandas in
    # every worker, cost more of an executor's memory than the scores do.
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((score_text(t.as_py(), model) for t in texts), pa.float64(), size=len(texts))

    return score(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels the fit never sees. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model | None:
    """Fit on at most ``SAMPLE_ROWS`` labelled rows of each class, chosen by a hash of the id.

    The classes weigh by their numbers of labels, so the score does not depend on the sample's size.
    Of these so many that their texts have ``SAMPLE_BYTES`` together; only a text that is longer alone
    is never chosen. Rows of ``held_out`` ids and null labels are left out of the sample.
    The sampled ids are bounded, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    n = dict(known.groupBy("__label").count().collect())
    picked = None
    for value in (0, 1):
        rows = known.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_ROWS)
        picked = rows if picked is None else picked.unionByName(rows)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    found = texts.join(F.broadcast(picked), "__id")
    digest = F.xxhash64("__text").alias("__digest")
    # One text for each id. Only lengths are looked at, then the chosen texts are read.
    sizes = found.groupBy("__id", "__label").agg(F.min(F.struct(digest, F.octet_length("__text").alias("n"))).alias("one"))
    sizes = sizes.select("__id", "__label", "one.*").toPandas()
    sizes["__order"] = sizes["__id"].map(lambda i: zlib.crc32(str(i).encode()))
    sizes = sizes.sort_values(["__order", "__id"])
    sizes = sizes[sizes["n"] <= SAMPLE_BYTES]
    sizes = sizes[sizes.groupby("__label")["n"].cumsum() <= SAMPLE_BYTES]
    if not len(sizes):
        return None
    kind = docs.select(F.col(doc_id).alias("__id")).schema.add("__digest", "long").add("__label", "integer")
    chosen = docs.sparkSession.createDataFrame(
        list(zip(*(sizes[c].tolist() for c in ("__id", "__digest", "__label")), strict=True)), kind
    )
    sample = texts.withColumn("__digest", F.xxhash64("__text")).join(F.broadcast(chosen), ["__id", "__digest"])
    sample = sample.dropDuplicates(["__id"]).select("__id", "__text", "__label").toPandas().sort_values("__id")
    return fit(sample["__text"].tolist(), sample["__label"].tolist(), [n.get(0, 0), n.get(1, 0)])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = 0.3,
) -> DataFrame:
    """Add ``held_out, score, predicted`` to every row of ``docs``.

    Null and empty texts get the score of a text without windows. Repeated rows get equal scores.
    Columns of ``docs`` with one of the three names are replaced; other columns are kept and never
    read. An empty ``docs`` gives an empty table; without labels of both classes every score is 0.
    """
    model = train(docs, labels, doc_id, text, label)
    scored = docs.withColumns({"held_out": held_out(F.col(doc_id)), "score": toxicity(F.col(text), model)})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
