"""Prefix-stable context keys and hash buckets.

A context is a list of elements; each element has a hash ``h``.  The key of
the prefix of length ``k`` is ``"k:S1:S2"`` where ``S1``/``S2`` are sums over
positions ``p < k`` of two 60-bit integers cut from ``md5(f"{p}:{h}")``.
Because every term depends on its position, equal keys mean equal element
sequences (up to a ~2^-120 collision chance), and the key of a prefix can be
extended one element at a time.  The same formula is computed natively
(running window sums) and in Python (``python_prefix_keys``) so the two
paths can be mixed.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY_KEY = ""  # key of the empty context


def _term(pos: Column, h: Column, lo: int) -> Column:
    digest = F.md5(F.concat(pos.cast("string"), F.lit(":"), h))
    return F.conv(F.substring(digest, lo, 15), 16, 10).cast("decimal(38,0)")


def term1(pos: Column, h: Column) -> Column:
    return _term(pos, h, 1)


def term2(pos: Column, h: Column) -> Column:
    return _term(pos, h, 17)


def format_key(k: Column, s1: Column, s2: Column) -> Column:
    return F.concat_ws(":", k.cast("string"), s1.cast("string"), s2.cast("string"))


def running_prefix_keys(elems: DataFrame, partition_cols: list[str], pos_col: str,
                        hash_col: str, out_col: str = "prefix_key",
                        before_col: str | None = "key_before") -> DataFrame:
    """Add the key of the prefix ending at each element (and the one before it).

    ``elems`` holds one row per element; ``partition_cols`` identify one
    context.  Positions must be 0..n-1 without gaps.  The running sums use
    ``grouped_cumsum``, so a huge context is split across tasks; the key
    before an element subtracts its own terms (no second window).
    """
    pos, h = F.col(pos_col), F.col(hash_col)
    out = grouped_cumsum(elems.withColumn("_t1", term1(pos, h)).withColumn("_t2", term2(pos, h)),
                         partition_cols, [F.col(pos_col)], {"_s1": F.col("_t1"), "_s2": F.col("_t2")})
    out = out.withColumn(out_col, format_key(pos + 1, F.col("_s1"), F.col("_s2")))
    if before_col:
        out = out.withColumn(before_col, F.when(pos == 0, F.lit(EMPTY_KEY)).otherwise(
            format_key(pos, F.col("_s1") - F.col("_t1"), F.col("_s2") - F.col("_t2"))))
    return out.drop("_t1", "_t2", "_s1", "_s2")


@functools.lru_cache(maxsize=1 << 15)
def _py_term(pos: int, h: str) -> tuple[int, int]:
    d = hashlib.md5(f"{pos}:{h}".encode()).hexdigest()
    return int(d[:15], 16), int(d[16:31], 16)


def python_prefix_keys(hashes: list[str]) -> list[str]:
    """Python twin of ``running_prefix_keys`` for one context."""
    out, s1, s2 = [], 0, 0
    for p, h in enumerate(hashes):
        a, b = _py_term(p, h)
        s1 += a
        s2 += b
        out.append(f"{p + 1}:{s1}:{s2}")
    return out


def extend_key(key: str, pos: int, h: str) -> str:
    """Key of ``prefix + [h]`` given the key of ``prefix`` (length ``pos``)."""
    if key == EMPTY_KEY:
        s1 = s2 = 0
    else:
        _, a, b = key.split(":")
        s1, s2 = int(a), int(b)
    t1, t2 = _py_term(pos, h)
    return f"{pos + 1}:{s1 + t1}:{s2 + t2}"


def md5_bucket(s: Column, num_buckets: int) -> Column:
    """md5 of ``s`` read as a 128-bit unsigned integer, modulo ``num_buckets``.

    Horner's rule over four 32-bit limbs keeps every step below 2^63 for
    ``num_buckets < 2^31``; equal to Python's ``int(md5, 16) % n``.
    """
    if not 0 < num_buckets < 2 ** 31:
        raise ValueError("num_buckets must be in [1, 2^31)")
    d = F.md5(s)
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        limb = F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("bigint")
        acc = F.pmod(acc * F.lit(4294967296) + limb, F.lit(num_buckets))
    return acc.cast("int")


def global_row_index(df: DataFrame, order_cols: list, index_col: str = "row_index") -> DataFrame:
    """1-based global position of each row in ``order_cols`` order, distributed.

    ``order_cols`` must be a total order.  The frame is range-partitioned and
    sorted once; ``monotonically_increasing_id`` then carries (partition,
    position in partition).  Rows per partition (one small row each) become
    offsets that are broadcast back: no task or the driver holds the data,
    and the offsets table is bounded by the partition count.

    The numbered rows are materialised once.  Planned twice, the two sorts
    could differ (pruned columns, own samples) and ids would not line up.
    """
    from ..session import cut_lineage
    mask = (1 << 33) - 1
    local = (df.sort(*order_cols)
             .withColumn("_mid", F.monotonically_increasing_id())
             .withColumn("_part", F.shiftright(F.col("_mid"), 33))
             .withColumn("_local", F.col("_mid").bitwiseAND(F.lit(mask)) + 1))
    local = cut_lineage(local)
    counts = local.groupBy("_part").agg(F.max("_local").alias("_n"))
    wo = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).select("_part", "_off")
    return (local.join(F.broadcast(offsets), "_part")
            .withColumn(index_col, (F.col("_local") + F.col("_off")).cast("bigint"))
            .drop("_mid", "_part", "_local", "_off"))


def grouped_cumsum(df: DataFrame, group_cols: list[str], order_cols: list, sums: dict,
                   partitions: int | None = None) -> DataFrame:
    """Running sums within groups that stay correct and parallel for hot groups.

    ``sums`` maps an output column to a numeric Column; each output is the
    sum of its value over the rows of the group up to and including the
    current one in ``order_cols`` order (a total order within the group).

    A plain window would put a whole group in one task.  The rows are
    range-partitioned by ``(group, order)``, so a group holding a third of
    all rows spans many partitions; each partition sums locally per group,
    and the per-(partition, group) totals - at most one row per partition
    for any group - become offsets that are added back.  The locally summed
    rows are checkpointed once (reliable, shared folder) so both branches
    see the same partition ids; the checkpoint keeps the hash partitioning
    of the local window, so the join with the offsets moves only the small
    totals table.
    """
    spark = df.sparkSession
    names = list(sums)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.select("*", *[sums[k].alias(f"_v_{k}") for k in names])
    d = d.repartitionByRange(n, *[F.col(c) for c in group_cols], *order_cols).withColumn(
        "_gpart", F.spark_partition_id())
    wl = (Window.partitionBy("_gpart", *group_cols).orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for k in names:
        d = d.withColumn(f"_l_{k}", F.sum(f"_v_{k}").over(wl))
    # one range exchange for both branches: each exchange samples its own
    # bounds, so the partition ids must come from a single materialisation
    from ..session import cut_lineage
    d = cut_lineage(d)
    tot = d.groupBy("_gpart", *group_cols).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in names])
    wo = Window.partitionBy(*group_cols).orderBy("_gpart").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_gpart", *group_cols, *[F.sum(f"_t_{k}").over(wo).alias(f"_o_{k}") for k in names])
    out = d.join(off, ["_gpart", *group_cols], "left")
    for k in names:
        out = out.withColumn(k, F.col(f"_l_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0)))
    drop = ["_gpart"] + [f"_{p}_{k}" for k in names for p in ("v", "l", "o")]
    return out.drop(*drop)


def grouped_last(df: DataFrame, group_cols: list[str], order_cols: list[str], lasts: dict,
                 partitions: int | None = None) -> DataFrame:
    """Last non-null value so far within groups, parallel for hot groups too.

    ``lasts`` maps an output column to a Column; each output is its value in the
    last row of the group, up to and including the current one in
    ``order_cols`` order, in which it is not null.  The non-additive sibling of
    ``grouped_cumsum``: rows are range-partitioned by (group, order), each
    partition scans its own part of a group, and what the parts end with - one
    row per partition for any group - is scanned again to give every part the
    value that the parts before it carry over.  ``order_cols`` should be a total
    order; equal rows may end on either side of a partition's edge.
    """
    spark = df.sparkSession
    names = list(lasts)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in order_cols]
    d = df.select("*", *[lasts[k].alias(f"_v_{k}") for k in names])
    d = d.repartitionByRange(n, *[F.col(c) for c in group_cols], *order).withColumn("_gpart", F.spark_partition_id())
    wl = (Window.partitionBy("_gpart", *group_cols).orderBy(*order)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for k in names:
        d = d.withColumn(f"_l_{k}", F.last(f"_v_{k}", ignorenulls=True).over(wl))
    # one materialisation for both branches, as in grouped_cumsum
    from ..session import cut_lineage
    d = cut_lineage(d.drop(*[f"_v_{k}" for k in names]))
    ends = d.groupBy("_gpart", *group_cols).agg(*[
        F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.struct(*order))).alias(f"_e_{k}") for k in names])
    wo = Window.partitionBy(*group_cols).orderBy("_gpart").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_gpart", *group_cols, *[F.last(f"_e_{k}", ignorenulls=True).over(wo).alias(f"_c_{k}") for k in names])
    if not group_cols:
        carry = F.broadcast(carry)  # one row per partition
    out = d.join(carry, ["_gpart", *group_cols], "left")
    for k in names:
        out = out.withColumn(k, F.coalesce(F.col(f"_l_{k}"), F.col(f"_c_{k}")))
    return out.drop("_gpart", *[f"_{p}_{k}" for k in names for p in ("l", "c")])
