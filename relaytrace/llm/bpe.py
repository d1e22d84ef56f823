"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The ranks are read once per worker.  A long text is cut at safe boundaries
first: places where every match of the pre-splitting pattern ends, so the
encoded pieces joined are the encoding of the whole.  A long run of white space,
which has no such place, is matched here by the pattern's own two rules and
encoded as the one match it is, without the library's regex.  Decoding joins the raw
bytes of the ids; nothing passes through a lossy string.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaytrace.llm.common import narrow, vocab_path
from relaytrace.session import ship_package

VOCAB = "byte_bpe_multi_50k.tiktoken"
#: Code points from which a text is encoded piece by piece.
LONG_TEXT = 200_000
#: White-space characters in one match from which it is encoded by itself.
LONG_SPACE = 10_000
#: Rows that go back to Spark at once, so that ids of long texts do not pile up.
ROWS_OUT = 512

# A cut is safe where a match must end on its left and its right starts afresh:
# before ASCII white space that follows a letter, number or punctuation mark,
# and where an ASCII letter or digit run ends at another ASCII class.  Nothing
# in the pattern looks back, and a contraction only starts at its apostrophe.
# The pattern's white space: Unicode's White_Space, which Python's own class exceeds.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])")


def safe_pieces(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after every ``limit`` code points.

    A stretch without any boundary (one letter run) stays whole."""
    at = 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


@functools.lru_cache(maxsize=4)
def encoding(vocab: str):
    """tiktoken's encoder over a rank file; no special tokens."""
    import public_tokenizers
    import tiktoken

    with open(vocab_path(vocab), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocab, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def white_matches(text: str, least: int = LONG_SPACE) -> Iterator[tuple[int, int]]:
    """Where the pattern matches ``least`` or more white-space characters at once.

    A match begins with its run, since no other part of the pattern ends in white
    space.  ``\\s+(?!\\S)`` takes the run up to the text's end, or all but the last
    character before anything else; that one starts the next match."""
    for m in _SPACES.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if end - m.start() >= least:
            yield m.start(), end


def encode_text(text: str, vocab: str = VOCAB, limit: int = LONG_TEXT, least: int = LONG_SPACE) -> np.ndarray:
    enc = encoding(vocab)
    if len(text) <= limit:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    out, at = [], 0
    for start, end in [*white_matches(text, least), (len(text), len(text))]:
        out += [enc.encode_ordinary(p) for p in safe_pieces(text[at:start], limit)]
        if end > start:
            out.append(enc._encode_single_piece(text[start:end]))
        at = end
    return np.concatenate([np.array(ids, dtype="<u4") for ids in out])


def decode_ids(ids: np.ndarray, vocab: str = VOCAB) -> bytes:
    return encoding(vocab).decode_bytes(ids.tolist())


def _ids_column(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, "<u4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB,
           long_text: int = LONG_TEXT, raw: bool = False) -> DataFrame:
    """Ids of every whole text: ``(id_col, n_tokens, ids)``.

    ``ids`` is an ``array<int>``, or with ``raw`` its serialised form, binary of
    little-endian unsigned 32-bit integers.  A null or empty text has no ids;
    a null id stays null; repeated rows are encoded as often as they occur;
    an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    src = narrow(df, id_col, text_col)
    kind = "binary" if raw else "array<int>"
    id_type = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(lo, ROWS_OUT)
                ids = [encode_text(t, vocab, long_text) for t in part.column(1).to_pylist()]
                out = pa.array([a.tobytes() for a in ids], pa.binary()) if raw else _ids_column(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(a) for a in ids], pa.int64()), out], [id_col, "n_tokens", "ids"])

    return src.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint, ids {kind}")


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocab: str = VOCAB) -> DataFrame:
    """Adds ``out_col``: the raw bytes that the ids stand for (binary; no ids or
    null: empty).  ``ids_col`` is an array of ints or its serialised form."""
    ship_package(df.sparkSession)
    raw = df.schema[ids_col].dataType.simpleString() == "binary"

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if raw:
                ids = (np.frombuffer(v.as_buffer(), "<u4") if v.is_valid else np.empty(0, "<u4") for v in batch)
            else:
                ids = (np.asarray(v.values) if v.is_valid else np.empty(0, "<u4") for v in batch)
            yield pa.array([decode_ids(a, vocab) for a in ids], pa.binary())

    return df.withColumn(out_col, run(F.col(ids_col)))
