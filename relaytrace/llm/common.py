"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that a worker's memo of words may hold; it starts anew beyond that.
MEMO_ENTRIES = 1 << 20


def vocab_path(vocab: str) -> str:
    """Place of a vocabulary: a path is taken as it is, a bare name is looked
    up in ``public_tokenizers`` (so each worker finds its own installed copy)."""
    if os.path.dirname(vocab):
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text (null: empty) alone, under their own names; other
    columns, whatever their names, never reach the operator."""
    return df.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text_col))


def hash_sample(df: DataFrame, cols: list[str], most: int, total: int | None = None) -> DataFrame:
    """At most ``most`` rows of ``df``, picked by the hash of ``cols``.

    A cut of the hash by the row count comes first, so the one task that takes
    the rows reads about that many, however many partitions there are."""
    total = df.count() if total is None else total
    if total > most:
        df = df.where(F.pmod(F.xxhash64(*cols, F.lit(11)), F.lit(1 << 40)) < F.lit(int(most / total * (1 << 40)) + 1))
    return df.orderBy(F.xxhash64(*cols), *cols).limit(most)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the array's order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",")
