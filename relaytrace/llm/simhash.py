"""SimHash near duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes
of a text's word shingles.  To find all fingerprints within ``distance`` bits,
the bits are grouped into partitions (correlated bits together) with thresholds
t_i, sum(t_i) = distance - partitions + 1: two fingerprints within ``distance``
then agree in some partition up to t_i bits (t_i = -1: not probed).  A dynamic
program allots unequal thresholds by candidate counts estimated on a bounded
sample, and so picks the number of partitions as well.  The sample steers cost
alone; any allotment finds every link.

Every distinct fingerprint is put under its value in each probed partition and
under the values up to t_i bits away; those that meet are verified on all bits.
Values shared by very many fingerprints are cut into blocks, each pair of
blocks a task of its own, so no task holds an unbounded group.  A task reports
a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaytrace.llm.common import hash_sample, narrow
from relaytrace.llm.components import components
from relaytrace.session import scratch_path, ship_package

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints that meet under one value in one task; more are cut into blocks.
BLOCK = 2048
#: Distinct fingerprints from which bits are grouped and candidates estimated.
SAMPLE = 20_000
#: Cost of one probe row (shuffled) in compared pairs.
PROBE_COST = 60.0

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---- fingerprints -----------------------------------------------------------

def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text; 0 if it has no words."""
    words = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return 0
    if len(words) < shingle:
        words = [" ".join(words)]
        grams: Iterator[str] = iter(words)
        n = 1
    else:
        grams = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    while part := list(itertools.islice(grams, 1 << 16)):
        h = np.array([digest(g.encode(), SEED) for g in part], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """Column of the fingerprint of a text as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(v.as_py() or "", shingle) for v in batch], np.uint64).view(np.int64))

    return run(text)


# ---- partitions and thresholds ----------------------------------------------

def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Group the 64 bits into ``parts`` nearly equal partitions, correlated bits
    together: each partition grows from a free bit by the free bit that is most
    correlated with those it has."""
    with np.errstate(invalid="ignore", divide="ignore"):
        near = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    free, out = list(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        first = max(free, key=lambda b: (near[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (near[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """Fingerprints with all bits outside a partition cleared."""
    return fps & np.uint64(sum(1 << (63 - b) for b in group))


def _flips(group: list[int], radius: int) -> np.ndarray:
    """Masks that turn a partition's value into every value up to ``radius`` bits away."""
    masks = [sum(1 << (63 - b) for b in some) for r in range(radius + 1) for some in itertools.combinations(group, r)]
    return np.array(masks, np.uint64)


def _meets(vals: np.ndarray, masks: np.ndarray) -> float:
    """Pairs of a sample that meet when each is put under its value and the values one mask away."""
    uniq, n = np.unique(vals, return_counts=True)
    pairs = 0.0
    for m in masks:
        at = np.searchsorted(uniq, uniq ^ m)
        at[at == len(uniq)] = 0
        hit = uniq[at] == uniq ^ m
        pairs += float((n[hit] * (n[at[hit]] - (m == 0))).sum()) / 2
    return pairs


def allot(sample: np.ndarray, total: int, distance: int = DISTANCE, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """``[(bits, threshold)]`` of the probed partitions, at least estimated cost.

    For each number of partitions, a dynamic program hands out ``distance + 1``
    units; u units are threshold u - 1.  The sample's meeting pairs scale with
    the square of the input, its probes in proportion."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
    scale = total / max(len(sample), 1)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, most_parts + 1):
        groups = group_bits(bits, parts)
        costs = []
        for g in groups:
            vals, row = values(sample, g), [0.0]
            for u in range(1, distance + 2):
                masks = _flips(g, u - 1) if u <= 3 else None  # wider probes never pay
                if masks is None or len(masks) > 2500:
                    row.append(float("inf"))
                    continue
                # what no sample shows is still there: values meet by chance
                chance = total * total / 2 * len(masks) / 2.0 ** len(g)
                seen = _meets(vals, masks if len(masks) <= 64 else masks[:64]) * max(1.0, len(masks) / 64) * scale * scale
                row.append(max(seen, chance) + PROBE_COST * total * len(masks))
            costs.append(row)
        # least[u]: cost and thresholds after the groups so far with u units handed out
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, got) in least.items():
                for u in range(distance + 2 - used):
                    c = cost + row[u]
                    if c < nxt.get(used + u, (float("inf"), []))[0]:
                        nxt[used + u] = (c, [*got, u - 1])
            least = nxt
        cost, got = least.get(distance + 1, (float("inf"), []))
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, got, strict=True) if t >= 0])
    if not best[1]:
        raise ValueError(f"no allotment for distance {distance}")
    return best[1]


# ---- links ------------------------------------------------------------------

def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(key: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal keys (sorted):
    pairs (fingerprint, least fingerprint it hangs together with)."""
    n = len(fps)
    label = np.arange(n)
    live = np.arange(n)
    a_all, b_all = [], []
    step = 1
    while True:
        live = live[live + step < n]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        hit = live[_popcount(fps[live] ^ fps[live + step]) <= distance]
        a_all.append(hit)
        b_all.append(hit + step)
        step += 1
        if sum(map(len, a_all)) > 2_000_000:  # dense groups: fold into labels now and then
            label = _fold(label, np.concatenate(a_all), np.concatenate(b_all))
            a_all, b_all = [], []
    if a_all:
        label = _fold(label, np.concatenate(a_all), np.concatenate(b_all))
    apart = fps[label] != fps
    return fps[apart], fps[label[apart]]


def _fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge labels along pairs; a label is the first row of its set."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """Links of distinct fingerprints (column ``fp``): ``(u, v)`` with the same
    components as the graph of all pairs within ``distance`` bits."""
    spark = fps.sparkSession
    ship_package(spark)
    total = fps.count()
    some = np.array([r[0] for r in hash_sample(fps.select("fp"), ["fp"], sample, total).collect()], np.int64).view(np.uint64)
    plan = [(i, np.uint64(sum(1 << (63 - b) for b in g)), _flips(g, t)) for i, (g, t) in enumerate(allot(some, total, distance))]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0)).view(np.uint64)
            for lo in range(0, len(x), 4096):
                part = x[lo:lo + 4096]
                for i, mask, flips in plan:
                    key = ((part & mask)[:, None] ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)),
                         pa.array(np.repeat(part, len(flips)).view(np.int64))], ["part", "value", "fp"])

    rows = fps.select("fp").mapInArrow(probe, "part int, value bigint, fp bigint")
    # values with many fingerprints: blocks by hash, and a row for each pair of blocks that its own is in
    hot = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block) \
        .select("part", "value", F.ceil(F.col("n") / (block / 2)).cast("int").alias("blocks"))
    dealt = rows.join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    group = ["part", "value", "a", "b"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def checked(cols: list[np.ndarray]) -> pa.RecordBatch:
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)])
            u, v = _forest(np.cumsum(new), cols[4].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(i)) for i in range(5)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            # the last group may go on in the next batch
            same = np.all([c[:] == c[-1] for c in cols[:4]], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield checked([c[:cut] for c in cols])
        if held is not None and len(held[0]):
            yield checked(held)

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(verify, "u bigint, v bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """``(id_col, fp, component_id)`` of every row: its fingerprint (signed 64
    bits) and the smallest id reachable over links of at most ``distance`` bits,
    its own included.

    Texts without words (null, empty) have fingerprint 0 and link like any
    other.  Repeated rows come out each; a null id stays null and never is a
    component's id unless all its ids are null; an empty table gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    src = narrow(df, id_col, text_col)
    at = scratch_path(spark, "fingerprints")
    src.select(id_col, fingerprint_column(F.col(text_col), shingle).alias("fp")).write.parquet(at)
    rows = spark.read.parquet(at)
    named = _with_least(rows.groupBy("fp").agg(F.min(id_col).alias("first")), distance)
    ids = named.groupBy("least").agg(F.min("first").alias("component_id"))
    of_fp = named.join(ids, "least").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(id_col, "fp", "component_id")


def _with_least(distinct: DataFrame, distance: int) -> DataFrame:
    """Distinct fingerprints (column ``fp``, others pass) with ``least``, the
    smallest fingerprint of their component."""
    spark = distinct.sparkSession
    at = scratch_path(spark, "distinct-fingerprints")
    distinct.write.parquet(at)
    fps = spark.read.parquet(at)
    at = scratch_path(spark, "links")
    links(fps, distance).distinct().write.parquet(at)
    comps = components(spark.read.parquet(at)).withColumnRenamed("node", "fp")
    return fps.join(comps, "fp", "left").withColumn("least", F.coalesce("least", "fp"))


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits of a signed 64-bit fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``df`` as
    they are: that of its smallest id, null ids last (of several texts under
    this id, one).  Ids need not be unique: a row is known by its id and the
    SHA-256 of its text, so every group, also one whose ids are all null, keeps
    exactly one row.
    """
    spark = df.sparkSession
    ship_package(spark)

    def key(c: str) -> Column:  # never null, so one exchange serves the join and the last step
        return F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))

    def digest(c: str) -> Column:
        return F.unhex(F.sha2(F.coalesce(F.col(f"`{c}`"), F.lit("")), 256))

    src = narrow(df, id_col, text_col)
    at = scratch_path(spark, "fingerprints")
    src.select(F.col(id_col).alias("id"), key(id_col).alias("_same_id"), digest(text_col).alias("_same_text"),
               fingerprint_column(F.col(text_col), shingle).alias("fp")).write.parquet(at)
    row = F.struct(F.col("id").isNull().alias("last"), "id", "_same_id", "_same_text")
    named = _with_least(spark.read.parquet(at).groupBy("fp").agg(F.min(row).alias("first")), distance)
    stay = named.groupBy("least").agg(F.min("first").alias("first")).select("first._same_id", "first._same_text")
    same = ["_same_id", "_same_text"]
    rows = df.withColumn("_same_id", key(id_col)).withColumn("_same_text", digest(text_col))
    return rows.join(stay, same, "left_semi").dropDuplicates(same).drop(*same)
