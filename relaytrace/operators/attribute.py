"""Backward as-of attribution of calls to run announcements.

Each call belongs to the most recent announcement at or before it; calls
before the first announcement get ``unknown``; the last announcement stays
open.

Calls and announcements become one time-ordered sequence, in which a call takes
the last announcement before it: ``grouped_last``, a distributed scan.  The
sequence is range-partitioned by time, so n rows cost one sort of n rows however
many calls and announcements fall into one minute; no pair of a call and an
announcement is ever formed.  Calls of one instant may span partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import grouped_last

# ---- fixed values ----------------------------------------------------------------
UNKNOWN_RUN = "unknown"  # attribution of calls before any announcement
# ----------------------------------------------------------------------------------


def asof_attribute(calls: DataFrame, announcements: DataFrame, call_ts: str = "ts",
                   ann_ts: str = "ts", ann_id: str = "instance_id", ann_tiebreak: str | None = None,
                   out_col: str = "instance_id", partitions: int | None = None) -> DataFrame:
    """``calls`` with ``out_col``, the id of the last announcement at or before each.

    Of announcements at one instant the last by ``ann_tiebreak`` (else by id)
    counts.  A call without a time is ``unknown``; an announcement without a time
    or id is none.  Both time columns need the same type."""
    tie = F.col(ann_tiebreak) if ann_tiebreak else F.col(ann_id).cast("string")
    tie_type = announcements.select(tie.alias("t")).schema["t"].dataType
    call_type = calls.schema
    seq_calls = calls.select(
        F.col(call_ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast(tie_type).alias("_tie"),
        F.monotonically_increasing_id().alias("_spread"), F.lit(None).cast("string").alias("_run"),
        F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("_call"))
    seq_ann = announcements.where(F.col(ann_ts).isNotNull() & F.col(ann_id).isNotNull()).select(
        F.col(ann_ts).alias("_ts"), F.lit(0).alias("_kind"), tie.alias("_tie"), F.lit(0).cast("bigint").alias("_spread"),
        F.col(ann_id).cast("string").alias("_run"), F.lit(None).cast(call_type).alias("_call"))
    # an announcement comes before the calls of its own instant
    seq = grouped_last(seq_calls.unionByName(seq_ann), [], ["_ts", "_kind", "_tie", "_spread"], {"_last": F.col("_run")}, partitions)
    seq = seq.where(F.col("_kind") == 1)
    return seq.select("_call.*", F.coalesce(F.when(F.col("_ts").isNotNull(), F.col("_last")), F.lit(UNKNOWN_RUN)).alias(out_col))
