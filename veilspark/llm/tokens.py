"""Token counts: batch encoding in Arrow functions that return lengths only.

The text never leaves its scan task. Inside the task a long text is cut into parts where the
vocabulary proves that no token can span the cut, parts of many texts are packed into batches of
about equal bytes, and one call of the tokenizer library encodes a batch. Only two numbers per text
go back to Spark, so memory is bounded by a batch however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


class PieceCounter:
    """Counts the tokens of texts with a sentencepiece model, without added special tokens.

    A cut is safe in front of a space that follows another character: the model turns a space into
    ``SPACE``, no piece of the vocabulary holds ``SPACE`` behind another character, and the model puts
    one ``SPACE`` in front of whatever it is given. The part behind the cut therefore drops its first
    space and gets it back. Both facts are read from the model; without them, texts stay whole.
    """

    def __init__(self, path: str, part_chars: int = 16_384, batch_bytes: int = 1 << 20) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.part_chars, self.batch_bytes = part_chars, batch_bytes
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        spans = any(SPACE in p.lstrip(SPACE) for p in pieces)
        probes = ("x", " x", "x  y", "x y ", "▁x")
        kept = [self.model.decode(self.model.encode(p)) for p in probes[:4]] == list(probes[:4])
        self.safe = kept and not spans and self.model.encode("x", out_type=str)[0].startswith(SPACE)

    def parts(self, text: str) -> Iterator[str]:
        """Cut a text; the counts of its parts add up to the count of the text."""
        start, size = 0, len(text)
        while self.safe and size - start > self.part_chars:
            cut = text.find(" ", start + self.part_chars)
            while cut > 0 and text[cut - 1] in (" ", SPACE):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut + 1 >= size:
                break
            yield text[start:cut]
            start = cut + 1
        yield text[start:]

    def counts(self, texts: Iterable[str]) -> list[int]:
        out: list[int] = []
        owners: list[int] = []
        batch: list[str] = []
        held = 0

        def flush() -> None:
            for owner, ids in zip(owners, self.model.encode(batch, num_threads=1), strict=True):
                out[owner] += len(ids)
            owners.clear()
            batch.clear()

        for k, text in enumerate(texts):
            out.append(0)
            for part in self.parts(text):
                owners.append(k)
                batch.append(part)
                held += len(part)
                if held >= self.batch_bytes:
                    flush()
                    held = 0
        flush()
        return out


@lru_cache(maxsize=4)
def _counter(path: str, part_chars: int, batch_bytes: int) -> PieceCounter:
    return PieceCounter(path, part_chars, batch_bytes)


def token_count(text: Column, model: str, part_chars: int = 16_384, batch_bytes: int = 1 << 20) -> Column:
    """Number of tokens of each text; null counts as empty. ``model`` is a path every executor has."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model, part_chars, batch_bytes)
        for texts in batches:
            yield pd.Series(counter.counts(texts), dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(df: DataFrame, text: str = "text", *, model: str, limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Columns of ``df``
    with one of the three names are replaced. An empty table gives an empty table.
    """
    n_bytes = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return df.withColumns({"n_tokens": token_count(F.col(text), model), "n_bytes": n_bytes}).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
