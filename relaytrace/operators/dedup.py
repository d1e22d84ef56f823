"""Prefix deduplication of calls within a session.

A call is dropped when a *later* call of the same session has a context
(system + messages, response excluded) that starts with its own; of equal
contexts the latest is kept, and an empty context is dropped whenever
anything follows it.

Equi form instead of pairwise ``startswith``: every call lists the keys of
all its context prefixes (``functions.keys``).  ``max(call_order)`` per
``(session, prefix key)`` is the last call extending that prefix; a call is
kept iff that maximum, looked up at its own full-context key, is itself.
Cost is one aggregation over the prefix keys (partial aggregation runs
map-side) and one join of one row per call.  No session is ever gathered in
one task: the aggregation is keyed by ``(session, key)`` and a call's own
row is bounded by the call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import EMPTY_KEY


def explode_keys(calls: DataFrame, keys_col: str, session: str = "session_id",
                 order: str = "call_order", out_col: str = "dkey") -> DataFrame:
    """Array form -> one row per (call, prefix key)."""
    return calls.select(session, order, F.explode(keys_col).alias(out_col))


def prefix_dedup(ctx: DataFrame, calls: DataFrame, session: str = "session_id",
                 order: str = "call_order", key: str = "dkey",
                 own_key: str = "ctx_dkey") -> DataFrame:
    """Flag calls that survive prefix deduplication.

    ``ctx``: one row per (call, context element) with ``key`` = dedup key of
    the prefix ending at that element.  ``calls``: one row per call with
    ``own_key`` = key of its whole context (``''`` when empty).
    Returns ``calls`` plus boolean ``kept``.
    """
    prefixes = (ctx.select(session, order, F.col(key).alias("_pk"))
                .unionByName(calls.select(session, order, F.lit(EMPTY_KEY).alias("_pk"))))
    last = (prefixes.groupBy(session, "_pk").agg(F.max(order).alias("_last"))
            .withColumnRenamed("_pk", own_key))
    return (calls.join(last, [session, own_key], "left")
            .withColumn("kept", F.coalesce(F.col("_last") == F.col(order), F.lit(True)))
            .drop("_last"))
