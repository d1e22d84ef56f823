"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and line ends, pieces into words.  A
window of words whose hash is a multiple of ``period`` ends one chunk and
starts the next, so equal passages are cut alike wherever they stand and
neighbouring chunks overlap by that window.  The distinct chunks with their
parse frequencies are the dictionary: a passage that thousands of documents
share is counted once.

N-grams are then counted inside the distinct chunks, weighted by the parse
frequency.  The window is one word shorter than the longest phrase, so every
phrase lies whole inside the chunk in which it starts ahead of the overlap, and
is counted there alone.  Most phrases are rare, so words and then pairs of
frequent words are first counted by hash; bit tables of the frequent hashes
(which may let a rare one through, never lose a frequent one) then tell where
phrases can be frequent.  The counts that are returned are of the phrases
themselves, not of hashes.  The tables have a fixed largest size and are the
only thing that is broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaytrace.session import scratch_path, ship_package

#: Words of the longest phrase; the trigger window has one less.
LONGEST = 5
#: Occurrences from which a phrase is a candidate.
LEAST = 100
#: Phrases returned for each language.
TOP = 2000
#: One window in so many ends a chunk.
PERIOD = 8
#: Bytes of text that a task looks at together.
BLOCK = 1 << 20
#: Largest size of the bit table (bits): 8 MB.
TABLE_BITS = 1 << 26
#: First stage of the top list deals a language to so many groups.
DEAL = 64

_UND = "und"
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_CLASS = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(b".,;:!?\x0A\x0B\x0C\x0D")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for r in (_R, _RINV):
        x = np.full(size, r)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


class Words:
    """The words of some texts, in order, joined by single spaces in ``buf``.

    ``at`` and ``end`` are their places there, ``piece`` and ``text`` the piece
    and the text that they stand in, ``h`` a hash of each word."""

    def __init__(self, texts: pa.Array):
        joined = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
        _, offsets, chars = joined.buffers()
        ends = np.frombuffer(offsets, np.int32)[joined.offset:joined.offset + len(joined) + 1]
        data = np.frombuffer(chars, np.uint8)[ends[0]:ends[-1]] if len(joined) else np.zeros(0, np.uint8)
        #: Byte before the end of each text, a space where a chunk goes on.
        self.tail = data[np.maximum(ends[1:] - ends[0] - 2, 0)]
        kind = _CLASS[data]
        word = kind == 0
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        start, stop = edge[::2], edge[1::2]
        size = stop - start
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, start)
        per_text = np.diff(np.searchsorted(start, ends - ends[0]))
        self.text = np.repeat(np.arange(len(joined)), per_text)
        #: Words from each on to its text's end.
        self.left = np.repeat(np.cumsum(per_text), per_text) - np.arange(len(start))
        word[stop] = True
        clean = _LOWER[data]
        clean[stop] = 0x20
        self.clean = clean[word]
        self.end = np.cumsum(size + 1) - 1
        self.at = self.end - size
        if len(start):
            with np.errstate(over="ignore"):
                up, down = (x[:len(self.clean)] for x in _powers(max(BLOCK + (BLOCK >> 1), 1 << (len(self.clean) - 1).bit_length() if len(self.clean) > BLOCK else 0)))
                total = np.zeros(len(self.clean) + 1, np.uint64)
                np.multiply(self.clean, up, out=total[1:])
                total[1:] += up  # a zero byte counts as well
                np.cumsum(total, out=total)
                self.h = _mix((total[self.end] - total[self.at]) * down[self.at] + size.astype(np.uint64))
        else:
            self.h = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.at)

    def phrases(self, first: np.ndarray, last: np.ndarray, more: np.ndarray | int = 0) -> pa.Array:
        """The words from ``first`` to ``last``, and the space after them where ``more`` is 1."""
        buf = self.clean.tobytes()
        return pa.array([buf[a:b] for a, b in zip(self.at[first].tolist(), (self.end[last] + more).tolist(), strict=True)], pa.binary())

    def ids(self) -> tuple[np.ndarray, int]:
        """Numbers that equal words share, and how many there are."""
        keep = np.ones(len(self.clean), bool)
        keep[self.end] = False
        sizes = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.end - self.at, out=sizes[1:])
        words = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(sizes), pa.py_buffer(self.clean[keep])]).dictionary_encode()
        return words.indices.to_numpy().astype(np.int64), len(words.dictionary)


def chunk_bounds(w: Words, window: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and whether the piece goes on, of every chunk."""
    n = len(w)
    opens = np.ones(n, bool)
    opens[1:] = w.piece[1:] != w.piece[:-1]
    trig = np.zeros(n, bool)
    if window < n:
        with np.errstate(over="ignore"):
            h = np.zeros(n - window + 1, np.uint64)
            for j in range(window):
                h = h * _K + w.h[j:n - window + 1 + j]
            hit = _mix(h) % np.uint64(period) == 0
        trig[:n - window + 1] = hit & (w.piece[:n - window + 1] == w.piece[window - 1:])
    first = np.flatnonzero(opens | trig)
    nxt = np.append(first[1:], n)
    on = np.append(~opens[first[1:]], False)
    return first, nxt + np.where(on, window, 0), on


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows whose first column is a text, by about ``block`` bytes; a longer text
    is cut at the first piece end after each ``block`` bytes."""
    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        batch = batch.set_column(0, "text", batch.column(0).cast(pa.binary()))
        total = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False))])
        lo = 0
        while lo < batch.num_rows:
            hi = max(int(np.searchsorted(total, total[lo] + block - size)), lo + 1)
            hi = min(hi, batch.num_rows)
            if hi == lo + 1 and total[hi] - total[lo] > block:
                yield from _cut(batch.slice(lo, 1), block)
            else:
                some.append(batch.slice(lo, hi - lo))
                size += int(total[hi] - total[lo])
            if size >= block:
                yield pa.concat_batches(some)
                some, size = [], 0
            lo = hi
        if some and sum(b.num_rows for b in some) >= 1 << 17:  # many empty texts
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def _cut(row: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    text, at = row.column(0)[0].as_py(), 0
    while at < len(text):
        m = _END.search(text, at + block) if len(text) - at > block else None
        end = m.end() if m else len(text)
        yield row.set_column(0, "text", pa.array([text[at:end]], pa.binary()))
        at = end


def parse(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
          period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """``(lang, chunk, n)``: the dictionary of distinct chunks of a table's texts.

    ``n`` is the parse frequency.  A chunk that ends with a space goes on in
    another chunk, which starts with its last ``longest - 1`` words.
    """
    ship_package(df.sparkSession)
    src = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit(_UND)).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            w = Words(rows.column(0))
            if not len(w):
                continue
            first, end, on = chunk_bounds(w, longest - 1, period)
            seen = pa.table({"lang": rows.column(1).take(pa.array(w.text[first])), "chunk": w.phrases(first, end - 1, on.astype(np.int64))})
            got = seen.group_by(["lang", "chunk"], use_threads=False).aggregate([([], "count_all")])
            for b in got.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("chunk").cast(pa.string()), b.column("count_all")], ["lang", "chunk", "n"])

    return src.mapInArrow(run, "lang string, chunk string, n bigint").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def _gram_hashes(w: Words, salt: np.ndarray, words: int) -> np.ndarray:
    """Hash of the ``words`` words from each place on, with the language's hash."""
    n = len(w) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = salt[:n]
        for j in range(words):
            h = h * _K + w.h[j:n + j]
        return _mix(h)


def _salts(langs: pa.Array, text: np.ndarray) -> np.ndarray:
    """A number of each word's language."""
    codes = langs.dictionary_encode()
    of = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in codes.dictionary.to_pylist()]
    return np.array(of, np.uint64)[codes.indices.to_numpy()][text]


def _known(table: tuple[bytes, int], hashes: np.ndarray) -> np.ndarray:
    raw, size = table
    bits = np.frombuffer(raw, np.uint8)
    slot = hashes & np.uint64(size - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _starting(w: Words, words: int, longest: int) -> np.ndarray:
    """Whether a phrase of so many words starts at each place of a chunk and is counted there."""
    on = (w.tail == 0x20)[w.text]
    return (w.left >= words) & ~(on & (w.left < longest))


def count_hashes(dictionary: DataFrame, words: int, table: tuple[bytes, int] | None, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """``(h, n)``: occurrences by hash of the phrases of ``words`` words, of those
    alone whose words all stand in the bit ``table``."""
    shared = dictionary.sparkSession.sparkContext.broadcast(table) if table else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            w = Words(rows.column(0))
            salt = _salts(rows.column(1), w.text)
            h = _gram_hashes(w, salt, words)
            live = _starting(w, words, longest)[:len(h)]
            if shared:
                known = _known(shared.value, _gram_hashes(w, salt, 1))
                for j in range(words):
                    live &= known[j:len(h) + j]
            at = np.flatnonzero(live)
            weight = rows.column(2).to_numpy()[w.text[at]]
            codes = pa.array(h[at].view(np.int64)).dictionary_encode()
            total = _weighted(codes.indices.to_numpy(), weight, len(codes.dictionary))
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array(total)], ["h", "n"])

    src = dictionary.select("chunk", "lang", "n")
    return src.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _weighted(codes: np.ndarray, weight: np.ndarray, many: int) -> np.ndarray:
    """Exact sums of whole weights by code (bincount's doubles hold 2**53)."""
    high, low = np.divmod(weight, 1 << 26)
    out = np.bincount(codes, weights=low, minlength=many).astype(np.int64)
    return out + (np.bincount(codes, weights=high, minlength=many).astype(np.int64) << 26) if high.any() else out


def count_phrases(dictionary: DataFrame, tables: dict[int, tuple[bytes, int]], longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """``(lang, phrase, words, n)``: exact counts of the phrases of 1 to ``longest``
    words inside the chunks of ``dictionary``, of those alone whose words (one) or
    pairs of neighbouring words (more) all stand in the bit tables 1 and 2."""
    shared = dictionary.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for rows in _blocks(batches, block):
            w = Words(rows.column(0))
            if not len(w):
                continue
            salt = _salts(rows.column(1), w.text)
            langs = rows.column(1).dictionary_encode()
            lang, weights = langs.indices.to_numpy().astype(np.int64)[w.text], rows.column(2).to_numpy()[w.text]
            ids, many = w.ids()
            pairs = _known(tables[2], _gram_hashes(w, salt, 2)) if 2 in tables else np.zeros(0, bool)
            live = _known(tables[1], _gram_hashes(w, salt, 1))
            # numbers of the phrases so far, exact: equal if and only if the phrases are
            code = lang * many + ids
            for words in range(1, longest + 1):
                if words > 1:
                    n = len(w) - words + 1
                    if n <= 0 or 2 not in tables:
                        break
                    # the phrase without its last word is live as well, so its number is set
                    live = live[:n] & pairs[words - 2:words - 2 + n]
                place = np.flatnonzero(live)
                if not len(place):
                    break
                if words > 1:
                    code[place] = code[place] * many + ids[place + words - 1]
                found = pa.array(code[place]).dictionary_encode()
                dense = found.indices.to_numpy()
                code = np.zeros(len(w), np.int64)
                code[place] = dense
                ok = _starting(w, words, longest)[place]
                total = _weighted(dense[ok], weights[place[ok]], len(found.dictionary))
                one = np.zeros(len(found.dictionary), np.int64)
                one[dense] = place  # some place of each
                pick = one[total > 0]
                out = pa.table({"lang": langs.dictionary.take(pa.array(lang[pick])), "phrase": w.phrases(pick, pick + words - 1).cast(pa.string()),
                                "words": np.full(len(pick), words, np.int32), "n": total[total > 0]})
                yield from out.to_batches(max_chunksize=1 << 16)

    src = dictionary.select("chunk", "lang", "n")
    got = src.mapInArrow(run, "lang string, phrase string, words int, n bigint")
    return got.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("n"))


def bit_table(hashes: DataFrame, rows: int, most: int = TABLE_BITS) -> tuple[bytes, int]:
    """Bit table of hashes (column ``h``), about sixteen bits each and never over
    ``most`` bits, which bounds what reaches the driver and the tasks."""
    size = 1 << 10
    while size < min(16 * rows, most):
        size *= 2
    slot = F.col("h").bitwiseAND(F.lit(size - 1))
    found = hashes.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast((h & {size - 1}) & 63 as int))").alias("bit"))
    got = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.int64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return table.astype("<i8").tobytes(), size


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
                     period: int = PERIOD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, n)`` of every phrase of 1 to ``longest`` words with
    ``n >= least`` occurrences, and ``(lang, n)``: all words of each language."""
    spark = df.sparkSession

    def written(x: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        x.write.parquet(path)
        return spark.read.parquet(path)

    dictionary = written(parse(df, text_col, lang_col, longest, period, block), "chunks")
    spaces = F.length("chunk") - F.length(F.replace("chunk", F.lit(" "), F.lit("")))
    starts = F.when(F.endswith("chunk", F.lit(" ")), spaces - (longest - 1)).otherwise(spaces + 1)
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("n") * starts).alias("n"))
    tables: dict[int, tuple[bytes, int]] = {}
    for words in (1, 2):
        found = written(count_hashes(dictionary, words, tables.get(1), longest, block).where(F.col("n") >= least).select("h"), f"hashes{words}")
        rows = found.count()
        if rows or words == 1:
            tables[words] = bit_table(found, rows)
        if not rows:
            break
    return written(count_phrases(dictionary, tables, longest, block).where(F.col("n") >= least), "phrases"), totals


def _wide(name: str):
    return F.col(name).cast("decimal(38,0)")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 top: int = TOP, share: int = 100, period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    Words are lower-cased in A-Z.  A candidate is a phrase of 2 to ``longest``
    words with ``a >= least`` occurrences.  Cutting it in two parts of ``l`` and
    ``r`` occurrences scores ``floor(1000 * a * n / (l * r))``, n being the
    language's words; the lowest-scoring cut counts, of equal ones that after
    the fewest words.  Candidates within a longer candidate of at least
    ``share`` percent of their occurrences are dropped.  Order: score, then a,
    descending, then the phrase's bytes.

    A null or empty text has no words, a null language is ``und``; repeated rows
    count each; other columns are not read; an empty table gives no rows.
    """
    frequent, totals = frequent_phrases(df, text_col, lang_col, longest, least, period, block)
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cand = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a")).join(totals, "lang")
    cuts = (cand.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
            .withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("tail", F.expr("substring_index(phrase, ' ', k - words)")))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("num", F.lit(1000).cast("decimal(38,0)") * _wide("a") * _wide("n")).withColumn("den", _wide("l") * _wide("r"))
    cuts = cuts.withColumn("score", F.expr("num div den"))
    scored = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a longer candidate with as many occurrences passes through one that is a word longer
    longer = cand.where("words > 2")
    inner = longer.select("lang", F.col("a").alias("f"), F.explode(F.array(
        F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.expr(f"f IS NULL OR 100 * f < {share} * a"))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(DEAL)))
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).where(F.col("_r") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
