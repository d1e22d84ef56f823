"""WARC archives: writing with revisit records, and reading by boundary chains.

Writing.  One record per page; of pages with equal payloads of some size the
smallest id is the response and the others are revisits that refer to it.

Reading.  A file is cut into byte ranges, one task each.  The record magic may
also occur inside a payload, so a task only proposes: for every magic in its
range the offset and the offset of the record that would follow.  It follows
these links inside its own range and emits, per candidate, where the chain
leaves the range.  Pointer jumping over these exits, from offset 0 of every
file, finds the one true entry of each range in logarithmically many rounds;
what is not reached from a file's start is a magic inside a payload.  Then each
range reads its records from its entry on.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaytrace.llm import files
from relaytrace.session import scratch_path, ship_package

#: Payloads below this size are never revisits.
REVISIT_BYTES = 100
#: Byte range that one task scans.
RANGE_BYTES = 8 << 20
_READ = 1 << 16

_MAGIC = b"WARC/1.1\r\n"
_GZ_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"^Content-Length:[ \t]*(\d+)[ \t]*\r$", re.I | re.M)
_URN = "urn:page:"


# ---- writing ----------------------------------------------------------------

def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``(id_col, url, payload, payload_digest, refers_to)``; the small side of
    the join holds one row per payload that occurs more than once, and only
    ids and digests meet on a digest, so a payload that a third of all pages
    share moves as narrow rows."""
    base = pages.select(F.col(f"`{id_col}`"), "url", F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"))
    base = base.withColumn("payload_digest", F.sha2("payload", 256))
    ids = base.where(F.octet_length("payload") >= least).select(id_col, "payload_digest")
    firsts = ids.groupBy("payload_digest").agg(F.min(id_col).alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # a copy of the smallest id's own row is the response again
    copies = ids.join(firsts, "payload_digest").where(~F.col(id_col).eqNullSafe(F.col("refers_to"))).distinct()
    c = copies.select(F.col(id_col).alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to")
    same = base[id_col].eqNullSafe(c["_id"]) & (base["payload_digest"] == c["_digest"])
    return base.join(c, same, "left").select(id_col, "url", "payload", "payload_digest", "refers_to")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, closed by its two line ends."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return _MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = REVISIT_BYTES,
               gzip: bool = True, folder: str | None = None) -> str:
    """Write the archives; returns their folder, whose ``manifest`` lists
    ``(path, size)``.  Each task writes one file; ``gzip`` makes every record a
    member of its own (``.warc.gz``).

    A null page is an empty payload; a null id or url leaves the header empty
    or out; repeated rows get a record each (of the smallest id every copy is a
    response); an empty table makes no file.
    """
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path, size = f"{folder}/pages-{part:05d}.warc" + ".gz" * gzip, 0
        with files.written(path) as out:
            batch = first
            while batch is not None:
                for row in range(batch.num_rows):
                    page_id, url, html, digest, refers = (batch.column(i)[row].as_py() for i in range(5))
                    data = record(page_id, url, html.encode(), digest, refers)
                    data = gzipped(data) if gzip else data
                    out.write(data)
                    size += len(data)
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

    rows = with_revisits(pages, id_col, html_col, least)
    rows.mapInArrow(write, "path string, size bigint").write.parquet(f"{folder}/manifest")
    return folder


# ---- boundaries -------------------------------------------------------------

class _Bytes:
    """A file's bytes from ``at``, read on demand."""

    def __init__(self, f, at: int, size: int, first: int = _READ):
        self.f, self.at, self.size = f, at, size
        f.seek(at)
        self.data = f.read(min(first, size - at))

    def more(self) -> bool:
        at = self.at + len(self.data)
        if at >= self.size:
            return False
        self.f.seek(at)
        self.data += self.f.read(min(max(_READ, len(self.data)), self.size - at))
        return True

    def upto(self, at: int, n: int) -> bytes | None:
        """``n`` bytes from the file's offset ``at``, or None beyond its end."""
        if at + n > self.size:
            return None
        while self.at + len(self.data) < at + n:
            self.more()
        return self.data[at - self.at:at - self.at + n]


def _header(buf: _Bytes, at: int) -> tuple[bytes, int] | None:
    """Header lines and block length of a plain record at ``at``."""
    lo = at - buf.at
    while (end := buf.data.find(b"\r\n\r\n", lo)) < 0:
        if len(buf.data) - lo > (1 << 20) or not buf.more():
            return None
    head = buf.data[lo:end + 2]
    m = _LENGTH.search(head)
    return (head, int(m[1])) if head.startswith(_MAGIC) and m else None


def _member(buf: _Bytes, at: int) -> tuple[bytes, int] | None:
    """Content of the gzip member at ``at`` and the offset behind it."""
    z, lo, out = zlib.decompressobj(31), at - buf.at, []
    while True:
        piece = buf.data[lo:lo + _READ]
        if not piece:
            if not buf.more():
                return None
            continue
        try:
            out.append(z.decompress(piece))
        except zlib.error:
            return None
        lo += len(piece)
        if z.eof:
            return b"".join(out), buf.at + lo - len(z.unused_data)


def successor(buf: _Bytes, at: int, gz: bool) -> int | None:
    """Offset behind the record that would start at ``at``; None if none could."""
    if gz:
        got = _member(buf, at)
        if got is None or not got[0].startswith(_MAGIC):
            return None
        return got[1]
    got = _header(buf, at)
    if got is None:
        return None
    end = at + len(got[0]) + 2 + got[1]
    return end + 4 if buf.upto(end, 4) == b"\r\n\r\n" else None


def candidates(path: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """``(offset, exit)`` of every possible record start in ``[lo, hi)``: exit is
    where the chain from there leaves the range, or -1 if it breaks inside."""
    gz = path.endswith(".gz")
    magic = _GZ_MAGIC if gz else _MAGIC
    f, size = files.opened(path)
    with f:
        buf = _Bytes(f, lo, size, hi - lo + len(magic) - 1)
        stop = min(hi, size) - lo + len(magic) - 1
        starts = [m.start() + lo for m in re.finditer(b"(?=" + re.escape(magic) + b")", buf.data[:stop])]
        after = {at: successor(buf, at, gz) for at in starts}
    out: dict[int, int] = {}
    for at in reversed(starts):
        nxt = after[at]
        out[at] = -1 if nxt is None else out.get(nxt, -1) if nxt < min(hi, size) else nxt
    return sorted(out.items())


def ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, size, lo, hi)``: the byte ranges of all files of a folder's manifest."""
    made = spark.read.parquet(f"{folder}/manifest")
    cut = made.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))))
    return cut.withColumn("hi", F.least(F.col("lo") + range_bytes, F.col("size"))).where("size > 0")


def entries(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, at)``: the first record reached from the file's start in each
    byte range, found by pointer jumping; written tables between the rounds."""
    cut = ranges(spark, folder, range_bytes)
    n, longest = cut.agg(F.count(F.lit(1)), F.max(F.ceil(F.col("size") / range_bytes))).first()

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = candidates(path, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()),
                     pa.array([b for _, b in found], pa.int64())], ["path", "at", "to"])

    reached = cut.where("lo = 0").select("path", F.lit(0).cast("bigint").alias("at"))
    if not n or longest <= 1:
        return reached
    jump_at = scratch_path(spark, "warc-jumps-0")
    cut.select("path", "lo", "hi").repartition(int(n)).mapInArrow(propose, "path string, at bigint, to bigint").where("to >= 0").write.parquet(jump_at)
    jump, step, k = spark.read.parquet(jump_at), 1, 0
    while step < longest:
        # reached: entries up to ``step`` ranges from the start; jump leads ``step`` exits on
        k += 1
        ahead = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        at = scratch_path(spark, f"warc-reached-{k}")
        reached.unionByName(ahead).distinct().write.parquet(at)
        reached = spark.read.parquet(at)
        step *= 2
        if step < longest:
            on = jump.select("path", F.col("at").alias("to"), F.col("to").alias("_to"))
            at = scratch_path(spark, f"warc-jumps-{k}")
            # a jump past the last record has no further one and stays reached by the shorter jumps
            jump.join(on, ["path", "to"]).select("path", "at", F.col("_to").alias("to")).write.parquet(at)
            jump = spark.read.parquet(at)
    return reached


# ---- reading ----------------------------------------------------------------

def _field(head: bytes, name: str) -> str | None:
    m = re.search(rb"^" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r$", head, re.I | re.M)
    return m[1].decode() if m else None


def _page(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{_URN}(-?\d+)>", value or "")
    return int(m[1]) if m else None


def parse_record(data: bytes) -> dict:
    """A record's fields, payload included (a revisit's payload is None; its
    size stands in the HTTP header it keeps)."""
    end = data.index(b"\r\n\r\n")
    head = data[:end + 2]
    block = data[end + 4:end + 4 + int(_LENGTH.search(head)[1])]
    cut = block.index(b"\r\n\r\n")
    revisit = _field(head, "WARC-Type") == "revisit"
    payload = None if revisit else block[cut + 4:]
    given = (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != given:
        raise ValueError("a payload does not match its digest")
    return {"page_id": _page(_field(head, "WARC-Record-ID")), "url": _field(head, "WARC-Target-URI"),
            "payload_bytes": int(_LENGTH.search(block[:cut + 2])[1]) if revisit else len(payload), "payload_digest": given,
            "record_type": "revisit" if revisit else "response", "refers_to": _page(_field(head, "WARC-Refers-To")), "payload": payload}


def records_from(path: str, at: int, hi: int) -> Iterator[bytes]:
    """Raw records of the chain from ``at`` that start before ``hi``."""
    gz = path.endswith(".gz")
    f, size = files.opened(path)
    with f:
        buf = _Bytes(f, at, size, hi - at)
        while at < min(hi, size):
            if gz:
                got = _member(buf, at)
                if got is None or not got[0].startswith(_MAGIC):
                    return
                data, nxt = got
            else:
                nxt = successor(buf, at, False)
                if nxt is None:
                    return
                data = buf.upto(at, nxt - at)
            yield data
            at = nxt


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Every record that the files' chains reach: ``(page_id, url, payload_bytes,
    payload_digest, record_type, refers_to[, payload])``.  A file damaged in
    the middle gives the records before the damage."""
    ship_package(spark)
    cut = ranges(spark, folder, range_bytes)
    found = entries(spark, folder, range_bytes).withColumn("lo", F.col("at") - F.col("at") % range_bytes)
    todo = found.join(cut, ["path", "lo"]).groupBy("path", "hi").agg(F.min("at").alias("at"))
    n = max(1, cut.count())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, hi in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows: list[dict] = []
                for data in records_from(path, at, hi):
                    rows.append(parse_record(data))
                    if not with_payload:
                        del rows[-1]["payload"]
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    out = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return todo.select("path", "at", "hi").repartition(n).mapInArrow(read, out + ", payload binary" * with_payload)
