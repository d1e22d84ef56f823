"""Token-id files with one shared zstandard dictionary.

A store is a folder.  ``dict-<sha256>.zdict`` is a dictionary trained on the
serialised id arrays of a bounded sample.  ``shard-NNNNN.tok`` holds documents
in ascending id order: a header with the dictionary's hash, one zstandard frame
per document, then an offset index (id, null flag, offset, ids) and a footer.
Any document, however short, is read by one seek and one small frame.
``manifest`` (Parquet) has one row per shard with the ids before it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relaytrace.llm import files
from relaytrace.llm.common import MEMO_ENTRIES, hash_sample, narrow, vocab_path
from relaytrace.session import scratch_path, ship_package

VOCAB = "word_bpe_49k.json"
END_ID = 2
#: The dictionary is fitted on at most so many documents (picked by hash) of at
#: most so many bytes each.
SAMPLE_DOCS, SAMPLE_DOC_BYTES = 2000, 8192
DICT_BYTES = 64 << 10
LEVEL = 3
#: Bytes of text that are encoded together.
PART_BYTES = 3 << 20

_MAGIC = b"TOKZ0001"
_FOOTER = "<QQ8s"  # place of the index, documents, magic
_LETTERS = re.compile("[a-z]+")
_MARKS = ".,;:!?$%&#*)"  # no special token ends with one
_INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n", "<u8")])


class _WordIds:
    """Serialised ids of words as the tokenizer gives them, remembered.

    Where the tokenizer drops white space and merges within words only, the ids
    of a text are those of its words in turn, gathered at once for many texts.
    Unknown words are encoded together with a symbol of one id between each two;
    words with that symbol alone.  For any other tokenizer (a probe tells)
    whole texts are encoded."""

    def __init__(self, vocab: str):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(vocab_path(vocab))
        # plain dicts: a set is compared with one by look-ups, with anything else by walking it all
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {"": b""}
        self.cut, self.cut_id = next(((c, ids[0]) for c in "^~`|#*" if len(ids := self.tok.encode(c, add_special_tokens=False).ids) == 1), ("", -1))
        # what neither the normaliser nor the pre-tokenizer changes can go straight to the model
        letters, t = string.ascii_lowercase, self.tok
        kept = t.normalizer is None or t.normalizer.normalize_str(letters) == letters
        # texts go word by word only if the tokenizer drops white space, merges within words and ignores case
        self.by_words = self._ignores("It's  a naive\n\nWord, of  4 MARKS\u00c9.\n X ")
        self.direct = kept and t.pre_tokenizer is not None and t.pre_tokenizer.pre_tokenize_str(letters) == [(letters, (0, 26))]

    def _ignores(self, text: str) -> bool:
        def ids(x: str) -> list[int]:
            return self.tok.encode(x, add_special_tokens=False).ids

        return ids(text) == [i for w in text.split() for i in ids(w)] == ids(text.lower()) and ids(f" {self.cut} ") == [self.cut_id]

    def learn(self, words: set[str]) -> None:
        """Most words are a stem and closing marks, which the tokenizer parts as
        well; capitals are lower-cased by it anyway.  So few stems are new."""
        parts = {}
        for w in words:
            stem = w.rstrip(_MARKS)
            low = stem.lower()
            if low and max(low) <= "\u024f" and low[-1].isalpha():
                parts[w] = (low, w[len(stem):])
            else:
                parts[w] = (w, "")
        self.ask({p for two in parts.values() for p in two}.difference(self.stems))
        stems = self.stems
        self.known.update({w: stems[a] + stems[b] for w, (a, b) in parts.items()})

    def ask(self, words: set[str]) -> None:
        cut, tokenize = self.cut, self.tok.model.tokenize
        plain = []
        for w in words:
            if self.direct and _LETTERS.fullmatch(w):
                ids = [t.id for t in tokenize(w)]
                self.stems[w] = struct.pack(f"<{len(ids)}I", *ids)
            elif cut in w:
                self.stems[w] = np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                plain.append(w)
        for lo in range(0, len(plain), 2000):
            some = plain[lo:lo + 2000]
            ids = np.array(self.tok.encode_batch_fast([f" {cut} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.cut_id)
            data, edges = ids.tobytes(), [-1, *at.tolist(), len(ids)]
            for w, a, b in zip(some, edges, edges[1:], strict=False):
                self.stems[w] = data[4 * a + 4:4 * b]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        # all words of the texts at once: cut at spaces and line ends, equal words numbered
        data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
        inside = (data != 0x20) & (data != 0x0A)
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        start, size = edge[::2], edge[1::2] - edge[::2]
        offsets = np.zeros(len(start) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(size, out=offsets[1:])
        kind = pa.string() if offsets.dtype == np.int32 else pa.large_string()
        words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        distinct, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        known = self.known
        if len(known) > MEMO_ENTRIES:
            known.clear()
        if len(self.stems) > MEMO_ENTRIES:
            self.stems = {"": b""}
        found = list(map(known.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            self.learn({distinct[i] for i in new})
            for i in new:
                found[i] = known[distinct[i]]
        table = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        first = np.cumsum(n) - n
        # the ids of all words in turn, gathered from those of the distinct ones
        many = n[at]
        ends = np.cumsum(many)
        ids = table[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[at] - (ends - many), many)].tobytes()
        bytes_ = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)) + 1
        last = np.searchsorted(start, np.cumsum(bytes_))  # words up to each text's end
        cuts = [0, *(4 * np.concatenate([[0], ends]))[last].tolist()]
        return [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def word_ids(vocab: str) -> _WordIds:
    return _WordIds(vocab)


def encode_texts(texts: list[str], vocab: str = VOCAB, end_id: int | None = END_ID) -> list[bytes]:
    """Serialised ids (little-endian unsigned 32-bit) of whole texts, each with the end id."""
    end = b"" if end_id is None else struct.pack("<I", end_id)
    return [ids + end for ids in word_ids(vocab).encode(texts)]


def train_dictionary(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[list[str]], list[bytes]],
                     dict_bytes: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary of the id arrays of a bounded sample of short
    documents; empty (no dictionary) if the sample is too small to train on.

    The sample is picked by Spark and fitted in one task: at most
    ``SAMPLE_DOCS * SAMPLE_DOC_BYTES`` bytes of text whatever the input."""
    short = df.where(F.octet_length(text_col).between(1, SAMPLE_DOC_BYTES))
    sample = hash_sample(short, [id_col, text_col], SAMPLE_DOCS, total=df.count()).select(text_col)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column(0).to_pylist()]
        arrays = [a for a in encoder(texts) if len(a) >= 8] if texts else []
        found = b""
        if sum(map(len, arrays)) >= 10 * 1024 and len(arrays) >= 8:
            size = min(dict_bytes, max(1024, sum(map(len, arrays)) // 10))
            try:
                found = zstandard.train_dictionary(size, arrays, level=LEVEL).as_bytes()
            except zstandard.ZstdError:  # too alike to learn from
                found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dict"])

    got = sample.coalesce(1).mapInArrow(fit, "dict binary").collect()
    return bytes(got[0]["dict"]) if got else b""


@functools.lru_cache(maxsize=2)
def _dictionary(folder: str, digest: str):
    data = files.read_all(f"{folder}/dict-{digest}.zdict")
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"dictionary {digest} is damaged")
    return zstandard.ZstdCompressionDict(data) if data else None


def _zstd(make, folder: str, digest: str, **more):
    d = _dictionary(folder, digest)
    return make(**more) if d is None else make(dict_data=d, **more)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of about ``PART_BYTES`` of text."""
    lo = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist()):
        size += n
        if size >= PART_BYTES:
            yield lo, i + 1 - lo
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts) - lo


def write_store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB,
                end_id: int | None = END_ID, folder: str | None = None) -> str:
    """Encode every whole text and write the store; returns its folder.

    Documents are dealt by ranges of ``id_col`` (a whole number; nulls come
    first, equal ids by the text's hash, so they may span shards), each task
    writes one shard.  A null text counts
    as empty and holds the end id alone; repeated rows are stored each; an
    empty table makes a store without documents.
    """
    spark = df.sparkSession
    ship_package(spark)
    folder = folder or scratch_path(spark, "tokens")
    src = narrow(df, id_col, text_col)
    found = train_dictionary(src, id_col, text_col, lambda texts: encode_texts(texts, vocab, end_id))
    digest = hashlib.sha256(found).hexdigest()
    with files.written(f"{folder}/dict-{digest}.zdict") as out:
        out.write(found)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        squeeze = _zstd(zstandard.ZstdCompressor, folder, digest, level=LEVEL)
        path, index, at = f"{folder}/shard-{shard:05d}.tok", [], len(_MAGIC) + 32
        with files.written(path) as out:
            out.write(_MAGIC + bytes.fromhex(digest))
            for batch in itertools.chain([first], batches):
                for lo, n in _parts(batch.column(1)):
                    part = batch.slice(lo, n)
                    for key, ids in zip(part.column(0).to_pylist(), encode_texts(part.column(1).to_pylist(), vocab, end_id), strict=True):
                        frame = squeeze.compress(ids)
                        out.write(frame)
                        index.append((key or 0, key is None, at, len(ids) // 4))
                        at += len(frame)
            table = np.array(index, _INDEX)
            out.write(table.tobytes())
            out.write(struct.pack(_FOOTER, at, len(index), _MAGIC))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(index)], pa.int64()),
             pa.array([int(table["n"].sum())], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    # rows of one id may fill several shards: they are dealt by their texts' hashes as well
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    dealt = src.repartitionByRange(*order).sortWithinPartitions(*order, text_col)
    dealt.mapInArrow(write, "shard int, path string, n_docs bigint, n_ids bigint").write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with ``start``: the ids of all shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _index(f, size: int) -> tuple[str, int, np.ndarray]:
    f.seek(0)
    head = f.read(len(_MAGIC) + 32)
    f.seek(size - struct.calcsize(_FOOTER))
    at, n, magic = struct.unpack(_FOOTER, f.read(struct.calcsize(_FOOTER)))
    if magic != _MAGIC or head[:len(_MAGIC)] != _MAGIC:
        raise ValueError("not a token shard")
    f.seek(at)
    return head[len(_MAGIC):].hex(), at, np.frombuffer(f.read(n * _INDEX.itemsize), _INDEX)


def read_document(folder: str, path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document of a shard, by its offset index."""
    f, size = files.opened(path)
    with f:
        digest, end, table = _index(f, size)
        known = table[table["null"] == 0]
        row = np.searchsorted(known["id"], doc_id)
        if row == len(known) or known["id"][row] != doc_id:
            return None
        at, n = int(known["offset"][row]), int(known["n"][row])
        later = table["offset"][table["offset"] > at]
        f.seek(at)
        frame = f.read((int(later.min()) if len(later) else end) - at)
    return np.frombuffer(_zstd(zstandard.ZstdDecompressor, folder, digest).decompress(frame, max_output_size=4 * n), "<u4")


def read_store(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Every document of a store, from its files: ``(id_col, start, n_tokens,
    ids_crc32[, ids])``; ``start`` counts the ids of all documents before it."""
    ship_package(spark)
    shards = manifest(spark, folder)
    n = max(1, spark.read.parquet(f"{folder}/manifest").count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, size = files.opened(path)
                with f:
                    digest, end, table = _index(f, size)
                    expand = _zstd(zstandard.ZstdDecompressor, folder, digest)
                    edges = np.append(table["offset"], end).astype(np.int64)
                    starts = start + np.concatenate([[0], np.cumsum(table["n"][:-1], dtype=np.int64)]).astype(np.int64)
                    for lo in range(0, len(table), 512):
                        rows = table[lo:lo + 512]
                        f.seek(int(edges[lo]))
                        data = f.read(int(edges[lo + len(rows)] - edges[lo]))
                        cuts = edges[lo:lo + len(rows) + 1] - edges[lo]
                        ids = [expand.decompress(data[a:b], max_output_size=4 * int(k)) for a, b, k in zip(cuts, cuts[1:], rows["n"], strict=False)]
                        if any(len(x) != 4 * int(k) for x, k in zip(ids, rows["n"], strict=True)):
                            raise ValueError(f"{path}: a document is damaged")
                        cols = [pa.array(rows["id"].astype(np.int64), mask=rows["null"].astype(bool)), pa.array(starts[lo:lo + len(rows)]),
                                pa.array(rows["n"].astype(np.int64)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                        names = [id_col, "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(cols, names)

    out = f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return shards.select("path", "start").repartition(n).mapInArrow(read, out)
