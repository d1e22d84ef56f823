"""Quality rules: plain counts, and zstandard compression bands.

The ratio raw / compressed bytes of a text says how repetitive it is.  The
whole document and every fixed chunk of it have a band of ratios; the band of
the whole depends on its length, as short texts compress less.  Repetitive
text lies above the band, random or encoded text below.  One chunk outside
its band rejects a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaytrace.llm.common import narrow
from relaytrace.session import ship_package

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Most words of repeated windows, in percent.
REPEATED_PERCENT = 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Bands(NamedTuple):
    """Limits of the ratio raw / compressed, inclusive."""

    #: (bytes from, least, most) for whole documents, by length.
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 4.0), (256, 1.1, 4.0), (1024, 1.35, 4.0), (4096, 1.4, 4.5), (16384, 1.4, 5.0), (65536, 1.4, 6.0))
    #: (least, most) for a chunk.
    chunk: tuple[float, float] = (1.35, 5.0)
    chunk_bytes: int = 4096
    #: A last chunk that is shorter than this is judged with the one before it.
    chunk_least: int = 1024
    level: int = 3


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that are found twice or more, the first included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    n = end = 0
    for at, gram in enumerate(grams):
        if seen[gram] > 1:
            n += at + window - max(at, end)
            end = at + window
    return n


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words))


def in_bands(data: bytes, squeeze: zstandard.ZstdCompressor, bands: Bands = Bands()) -> bool:
    """The bands' verdict on a text: the whole and every chunk inside; an empty one is outside."""
    if not data:
        return False
    ratio = len(data) / len(squeeze.compress(data))
    _, least, most = next(b for b in reversed(bands.whole) if len(data) >= b[0])
    if not least <= ratio <= most:
        return False
    starts = list(range(0, len(data), bands.chunk_bytes))
    if len(starts) > 1 and len(data) - starts[-1] < bands.chunk_least:
        starts.pop()
    if len(starts) == 1:
        return True
    chunks = (data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True))
    return all(bands.chunk[0] <= len(chunk) / len(squeeze.compress(chunk)) <= bands.chunk[1] for chunk in chunks)


VERDICT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
           "base_failed:boolean,kept:boolean>")


def verdict(text: Column, bands: Bands = Bands()) -> Column:
    """Struct of the counts, ``base_failed`` and ``kept`` of a text; see ``rules``."""

    @F.arrow_udf(VERDICT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for v in batch:
                t = v.as_py() or ""
                c = counts(t)
                failed = c[0] < MIN_WORDS or 100 * c[4] > REPEATED_PERCENT * c[0]
                rows.append((*c, failed, not failed and in_bands(t.encode(), squeeze, bands)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.StructArray.from_arrays(
                [*(pa.array(x, pa.int64()) for x in cols[:5]), *(pa.array(x, pa.bool_()) for x in cols[5:])],
                names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return run.asNondeterministic()(text)


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept)`` of every whole text.

    A null or empty text has no words and is not kept; a null id stays null;
    repeated rows are judged each, alike; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    src = narrow(df, id_col, text_col)
    return src.select(id_col, verdict(F.col(text_col), bands).alias("_v")).select(id_col, "_v.*")


def keep(df: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``df`` whose text the rules keep, with their columns as they are."""
    ship_package(df.sparkSession)
    return df.where(verdict(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), bands)["kept"])
