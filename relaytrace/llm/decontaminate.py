"""Benchmark decontamination: a BM25 index of the test items, searched by every
training passage with block-max WAND.

Every document is cut into overlapping passages, long enough to hold any item
whole.  A passage is a bag of words that asks the index for all items above a
threshold.  Impacts are BM25 weights divided by the item's own total, so a
score is the share of the item's weight that the passage holds.  What comes
back is verified on word n-grams of the item's question and answer.

The index holds the test set alone.  A test set beyond ``BLOCK_ITEMS`` items or
``BLOCK_CHARS`` characters is searched block by block (statistics are over all
items), so what a task receives stays bounded.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaytrace.llm.common import narrow
from relaytrace.session import ship_package

K1, B = 1.2, 0.75
#: Share of an item's BM25 weight from which it is retrieved.
THRESHOLD = 0.4
#: Word n-grams that verify, and the shares of them a leak holds: of question
#: and answer each, or of both together.
NGRAM, EACH, TOGETHER = 5, 0.5, 0.6
PASSAGE_WORDS = 64
#: Items of a block, for which the index keeps each term's largest impact.
ITEM_BLOCK = 4
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


class Item(NamedTuple):
    item_id: int | None
    question: list[str]
    answer: list[str]
    df: dict[str, int]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item that is one text: its last sentence or
    line is the answer; an item of one sentence is a question without one."""
    parts = [p for p in _SENTENCE.split(text) if _WORD.search(p)]
    if len(parts) < 2:
        return text, ""
    return "\n".join(parts[:-1]), parts[-1]


def _grams(w: list[str]) -> set[tuple[str, ...]]:
    n = min(NGRAM, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


class Index:
    """Inverted index of test items: postings by item, and the largest impact of
    each term in each block of items."""

    def __init__(self, items: list[Item], n_items: int, mean_len: float, threshold: float = THRESHOLD):
        self.items, self.threshold = items, threshold
        self.term: dict[str, int] = {}
        posts: list[list[tuple[int, float]]] = [[]]  # term 0: any word that is in no item
        longest = 0
        for at, item in enumerate(items):
            text = item.question + item.answer
            longest = max(longest, len(text))
            tf: dict[str, int] = {}
            for w in text:
                tf[w] = tf.get(w, 0) + 1
            raw = {w: math.log(1 + (n_items - item.df[w] + 0.5) / (item.df[w] + 0.5)) * f * (K1 + 1)
                   / (f + K1 * (1 - B + B * len(text) / mean_len)) for w, f in tf.items()}
            whole = sum(raw.values())
            for w, x in raw.items():
                t = self.term.setdefault(w, len(posts))
                if t == len(posts):
                    posts.append([])
                posts[t].append((at, x / whole))
        self.docs = [[d for d, _ in p] for p in posts]
        self.impact = [[x for _, x in p] for p in posts]
        self.window = max(PASSAGE_WORDS, 2 * longest)
        # each term's blocks of items and its largest impact in each, end to end
        self.n_blocks = -(-len(items) // ITEM_BLOCK)
        maxima = [{} for _ in posts]
        for top, p in zip(maxima, posts, strict=True):
            for d, x in p:
                top[d // ITEM_BLOCK] = max(x, top.get(d // ITEM_BLOCK, 0.0))
        self.first = np.cumsum([0, *map(len, maxima)])
        self.block = np.array([b for top in maxima for b in top], np.int64)
        self.block_max = np.array([x for top in maxima for x in top.values()])
        self.most = [max(x, default=0.0) for x in self.impact]

    def passages(self, terms: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Passages (word ranges), each with the blocks of items whose maxima
        over the passage's terms add up to the threshold."""
        n, step = len(terms), self.window // 2
        last = max(0, -(-n // step) - 2)  # passages start every half window; the last ends with the text
        many = max(1, 2_000_000 // self.n_blocks)
        for w0 in range(0, last + 1, many):
            w1 = min(w0 + many, last + 1)
            at = np.arange(w0 * step, min(n, (w1 + 1) * step))
            at = at[terms[at] > 0]
            half = at // step
            pairs = [(h[keep] - w0) * len(self.docs) + terms[at[keep]]
                     for h in (half, half - 1) for keep in [(h >= w0) & (h < w1)]]
            pairs = np.unique(np.concatenate(pairs))
            win, term = np.divmod(pairs, len(self.docs))
            n_of = self.first[term + 1] - self.first[term]
            entry = np.repeat(self.first[term] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())
            bound = np.bincount(np.repeat(win, n_of) * self.n_blocks + self.block[entry], self.block_max[entry])
            hit = np.flatnonzero(bound >= self.threshold - 1e-9)
            for w in np.unique(hit // self.n_blocks):
                lo = int(w0 + w) * step
                yield lo, min(n, lo + self.window), (hit[hit // self.n_blocks == w] % self.n_blocks).tolist()

    def search(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """The items of a block whose score reaches the threshold, by WAND: lists
        in the order of their next item, the first place where their block
        maxima add up to the threshold is the pivot, all before it leap there."""
        floor, end, out = self.threshold - 1e-9, (block + 1) * ITEM_BLOCK, []
        docs, impact = self.docs, self.impact

        def leap(place: int, term: int, to: int) -> list | None:
            at = bisect.bisect_left(docs[term], to, place)
            return [docs[term][at], at, term] if at < len(docs[term]) and docs[term][at] < end else None

        cur = [c for t in terms if (c := leap(0, t, block * ITEM_BLOCK))]
        top = {c[2]: max(impact[c[2]][c[1]:bisect.bisect_left(docs[c[2]], end, c[1])]) for c in cur}
        while cur:
            cur.sort()
            total, pivot = 0.0, None
            for c in cur:
                total += top[c[2]]
                if total >= floor:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cur[0][0] == pivot:
                here = [c for c in cur if c[0] == pivot]
                score = sum(impact[c[2]][c[1]] for c in here)
                if score >= floor:
                    out.append((pivot, score))
                pivot += 1
            cur = [x for c in cur if (x := c if c[0] >= pivot else leap(c[1], c[2], pivot))]
        return out

    def matches(self, text: str) -> list[dict]:
        """Verified leaks of a whole text: the best passage for each item."""
        w = words(text)
        get = self.term.get
        terms = np.array([get(x, 0) for x in w], np.int64)
        best: dict[int, dict] = {}
        if not len(terms) or sum(map(self.most.__getitem__, terms.tolist())) < self.threshold - 1e-9:
            return []
        for lo, hi, blocks in self.passages(terms):
            query = sorted(set(terms[lo:hi].tolist()) - {0})
            found = [hit for b in blocks for hit in self.search(query, b)]
            if not found:
                continue
            seen: dict[int, set] = {}
            for at, score in found:
                item = self.items[at]
                of_q, of_a = _grams(item.question), _grams(item.answer)
                for g in of_q | of_a:
                    if len(g) not in seen:
                        seen[len(g)] = {tuple(w[i:i + len(g)]) for i in range(lo, hi - len(g) + 1)}
                in_q, in_a = (sum(g in seen[len(g)] for g in s) for s in (of_q, of_a))
                q = in_q / len(of_q) if of_q else 1.0
                a = in_a / len(of_a) if of_a else 1.0
                if (in_q + in_a and q >= EACH and a >= EACH) or in_q + in_a >= TOGETHER * (len(of_q) + len(of_a)):
                    if at not in best or score > best[at]["score"]:
                        best[at] = {"item_id": item.item_id, "score": score, "question_overlap": q, "answer_overlap": a, "first_word": lo}
        return [best[at] for at in sorted(best)]


MATCHES = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,first_word:bigint>>"
MATCHES_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                                    ("answer_overlap", pa.float64()), ("first_word", pa.int64())]))


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None,
            threshold: float = THRESHOLD) -> Iterator[Index]:
    """Indexes of the test set, block by block; statistics are over all items.

    Without ``answer_col`` the answer is the text's last sentence.  Items
    without words are left out; repeated rows count once."""
    ship_package(items.sparkSession)
    src = items.select(F.col(f"`{id_col}`").cast("bigint").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("q"),
                       (F.lit(None) if answer_col is None else F.coalesce(F.col(f"`{answer_col}`"), F.lit(""))).cast("string").alias("a")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [halves(q) if a is None else (q, a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([words(p[i]) for p in pairs], pa.list_(pa.string())) for i in range(2))], ["item_id", "q", "a"])

    cut = src.mapInArrow(split, "item_id bigint, q array<string>, a array<string>").withColumn("t", F.concat("q", "a")).where(F.size("t") > 0)
    n, mean = cut.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    if not n:
        return
    key = F.xxhash64(F.col("item_id"), F.col("q"), F.col("a")).alias("key")
    terms = cut.select(key, F.explode(F.array_distinct("t")).alias("w"))
    df = terms.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    known = terms.join(df, "w").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "df"))).alias("df"))
    block: list[Item] = []
    chars = 0
    for row in cut.withColumn("key", key).join(known, "key").select("item_id", "q", "a", "df").orderBy("item_id", "q", "a").toLocalIterator():
        block.append(Item(row["item_id"], list(row["q"]), list(row["a"]), dict(row["df"])))
        chars += sum(map(len, block[-1].question + block[-1].answer))
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield Index(block, n, mean, threshold)
            block, chars = [], 0
    if block:
        yield Index(block, n, mean, threshold)


def leak_column(text: Column, index: Index) -> Column:
    """Array of the verified leaks of a text against one block."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(index)

    @F.arrow_udf(MATCHES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = shared.value
        for batch in batches:
            yield pa.array([ask.matches(v.as_py() or "") for v in batch], MATCHES_ARROW)

    return run.asNondeterministic()(text)


def _all_leaks(text: Column, items: DataFrame, **how) -> Column:
    cols = [leak_column(text, index) for index in indexes(items, **how)]
    return F.concat(*cols) if len(cols) > 1 else cols[0] if cols else F.array().cast(MATCHES)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(id_col, item_id, score, question_overlap, answer_overlap, first_word)``:
    a row for each document and test item it leaks, of the best passage (the
    first of equals).

    Null and empty texts leak nothing; a null id stays null; repeated rows are
    searched each; an empty test set or table gives no rows.  ``how`` goes to
    ``indexes``."""
    ship_package(docs.sparkSession)
    found = narrow(docs, id_col, text_col).select(id_col, _all_leaks(F.col(text_col), items, **how).alias("_m"))
    return found.select(id_col, F.explode("_m").alias("_m")).select(id_col, "_m.*")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that leak no test item, with their columns as they are."""
    ship_package(docs.sparkSession)
    return docs.where(F.size(_all_leaks(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), items, **how)) == 0)
