"""Token counts of a SentencePiece BPE model by heap and linked list.

Each stretch of text starts as its code points in a linked list; a heap holds
the adjacent pairs whose union is a piece, lowest rank first and leftmost on a
tie.  Popping and joining until the heap is empty leaves ``initial symbols -
merges`` tokens (a code point without a piece is as many byte tokens as it has
UTF-8 bytes).  No ids are made.

Two cuts keep the lists short without changing any count, because a merge
always yields a piece of the vocabulary: words (a piece has the space mark only
at its start) and, within a word, adjacent code points that no piece holds side
by side.  Counts of words and stretches are remembered per worker.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from relaytrace.llm.common import MEMO_ENTRIES, narrow, vocab_path
from relaytrace.session import ship_package

MODEL = "piece_bpe_32k.model"
MARK = "▁"


class _Memo(dict):
    def __init__(self, count, most: int = MEMO_ENTRIES):
        self.count, self.most = count, most

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(self) >= self.most:
            self.clear()
        if len(key) <= 64:
            self[key] = n
        return n


class PieceCounter:
    """Counts tokens as the model's library does, without begin, end or special
    tokens (their strings inside a text are ordinary text)."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=vocab_path(model))
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if not any(sp.is_byte(i) for i in range(n)):
            raise ValueError("a model with byte fallback is needed")
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece holds the space mark behind other characters")
        self.beside = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.of_stretch = _Memo(self.merge)
        self.of_word = _Memo(self.word)

    def merge(self, s: str) -> int:
        """Tokens of one stretch, by merging."""
        n, rank = len(s), self.rank
        symbols = sum(1 if c in rank else len(c.encode()) for c in s)
        if n == 1:
            return symbols
        part, nxt, prv = list(s), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, i + 1, p) for i in range(n - 1) if (p := s[i:i + 2]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            # stale unless both symbols are still there, side by side, as pushed
            if part[i] is None or nxt[i] != j or j >= n or part[j] is None or part[i] + part[j] != piece:
                continue
            merges += 1
            part[i], part[j] = piece, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (p := piece + part[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, k, p))
            h = prv[i]
            if h >= 0 and (p := part[h] + piece) in rank:
                heapq.heappush(heap, (rank[p], h, i, p))
        return symbols - merges

    def word(self, w: str) -> int:
        total, at, beside = 0, 0, self.beside
        for i in range(1, len(w)):
            if w[i - 1:i + 1] not in beside:
                total += self.of_stretch[w[at:i]]
                at = i
        return total + self.of_stretch[w[at:]]

    def __call__(self, text: str) -> int:
        return sum(map(self.of_word.__getitem__, self.words.findall(self.sp.normalize(text))))


@functools.lru_cache(maxsize=4)
def counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` of every whole text.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null;
    repeated rows are counted each; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    src = narrow(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(v.as_buffer()) for v in texts], pa.int64()),
                 pa.array([count(v.as_py()) for v in texts], pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
