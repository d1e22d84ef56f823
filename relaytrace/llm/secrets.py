"""Secret scans: fixed patterns, and a token-efficiency test.

The patterns find assignments, access keys and hex runs.  The test then looks
at what they leave of every unbroken run of key characters: random strings take
many tokens for few characters under a tiktoken vocabulary, natural words and
identifiers take few.  UUIDs, hex digests in upper case and numbers are left
out first.  A run is cut into parts at + / = _ and -, and each part is judged
by its own ratio, so a name or path before a key does not hide it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaytrace.llm.bpe import encoding
from relaytrace.llm.common import narrow
from relaytrace.session import ship_package

VOCAB = "byte_bpe_50k.tiktoken"
#: Characters a token at or below which a string is a secret ...
RATIO = 2.0
#: ... if it has at least so many characters.
LEAST = 20
#: Longest part between dense ones that may be efficient by chance.
GAP = 4

# the fixed patterns of the scan
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # a run's match is the whole run
KINDS = ("assign", "access", "hex", "token")

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUID
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"  # digest in upper case
    r")(?![A-Za-z0-9])")
_PART = re.compile(r"[A-Za-z0-9]+")
_LETTER = re.compile(r"[A-Za-z]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind; a
    match that fails its length test is dropped without another try."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _left(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What sorted spans leave of a stretch."""
    for a, b in taken:
        if start < a < end:
            yield start, a
        if a < end:
            start = max(start, b)
    if start < end:
        yield start, end


def _tokens(part: str, vocab: str) -> int:
    """Tokens of a part; words in capitals count as in small letters, if that is fewer."""
    encode = encoding(vocab).encode_ordinary
    n = len(encode(part))
    return min(n, len(encode(part.lower()))) if part.isalpha() and part.isupper() else n


def token_spans(text: str, taken: list[tuple[str, int, int]], vocab: str = VOCAB, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """Stretches that the token-efficiency test exposes, apart from ``taken`` spans.

    A part is dense if it is more than one token, with at most ``ratio``
    characters a token.  A secret runs from a dense part to a dense part of a
    run, short parts between them included, and is as dense as a whole; the =
    that end a run belong to it."""
    out = []
    held: list[tuple[int, int]] = []  # taken spans, joined where they overlap
    for a, b in sorted((a, b) for _, a, b in taken):
        if held and a <= held[-1][1]:
            held[-1] = held[-1][0], max(b, held[-1][1])
        else:
            held.append((a, b))
    first = 0
    for m in _RUN.finditer(text):
        # runs and spans both go up: each is passed once
        while first < len(held) and held[first][1] <= m.start():
            first += 1
        last = first
        while last < len(held) and held[last][0] < m.end():
            last += 1
        free = sorted(held[first:last] + [k.span() for k in _KNOWN.finditer(text, *m.span())])
        for start, end in _left(*m.span(), free):
            if end - start < LEAST:
                continue
            parts = [(*p.span(), _tokens(p[0], vocab)) for p in _PART.finditer(text, start, end)]
            groups: list[list[tuple[int, int, int]]] = [[]]
            between: list[tuple[int, int, int]] = []
            for a, b, n in parts:
                if n > 1 and b - a <= ratio * n:
                    groups[-1] += [*between, (a, b, n)]
                    between = []
                elif b - a > GAP:
                    groups.append([])
                    between = []
                elif groups[-1]:
                    between.append((a, b, n))
            for group in filter(None, groups):
                a, b = group[0][0], group[-1][1]
                if b - a < LEAST or not _LETTER.search(text, a, b) or sum(q - p for p, q, _ in group) > ratio * sum(n for _, _, n in group):
                    continue
                if not text[b:end].strip("="):
                    b = end
                out.append(("token", a, b))
    return out


def find(text: str, vocab: str = VOCAB, ratio: float = RATIO) -> list[tuple[str, int, int, bool]]:
    base = base_spans(text)
    spans = [(*s, True) for s in base] + [(*s, False) for s in token_spans(text, base, vocab, ratio)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def secret_spans(text: Column, vocab: str = VOCAB, ratio: float = RATIO) -> Column:
    """Column of the spans of a text, by start, then kind; see ``scan``."""

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("kind", "start", "end", "base")
        for batch in batches:
            yield pa.array([[dict(zip(names, s, strict=True)) for s in find(v.as_py() or "", vocab, ratio)] for v in batch], SPANS_ARROW)

    return run.asNondeterministic()(text)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, ratio: float = RATIO) -> DataFrame:
    """``(id_col, spans)``: the secrets of every whole text.

    A span has kind, start and end in code points (end exclusive) and whether
    a fixed pattern found it.  A null or empty text has none; a null id stays
    null; repeated rows are scanned each; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    src = narrow(df, id_col, text_col)
    return src.select(id_col, secret_spans(F.col(text_col), vocab, ratio).alias("spans"))
