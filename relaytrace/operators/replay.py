"""Replay kept calls to mark really generated assistant turns.

Reference semantics, per session: every call contributes its context hash
``h`` (thinking, signatures and cache hints ignored) with its response, in
time order.  Kept calls are then walked in time order; each history
assistant message whose preceding history hashes to ``h`` takes the next
unused response for ``h`` (FIFO): it is flagged ``generation`` and its
content is replaced by that response.  The final response of a kept call is
flagged when some quota for its own context hash is left (without consuming).

Native form (``mark_generation``): if every replacement leaves the history
hash unchanged ("neutral" – the usual case, since thinking is ignored), the
replay is a rank join: the n-th occurrence of ``h`` in replay order takes
the n-th call with context ``h``.  Occurrences and calls are numbered with
``row_number`` over ``(session, h)``; the final-response test is a running
count of occurrences at a probe row placed after the call's own history.
Sessions where some replacement changes the hash are replayed exactly by
levels (``frontier_replay``), as distributed rounds of the same rank join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import grouped_cumsum

_BIG = 1 << 62


def mark_generation(occ: DataFrame, kept_calls: DataFrame, providers: DataFrame,
                    session: str = "session_id", order: str = "call_order") -> tuple[DataFrame, DataFrame]:
    """Rank-join replay.

    ``occ``: history assistant messages of kept calls:
    ``session, order, pos, h`` (gen key of the history before the message),
    ``content_h`` (normalised content hash of the message).
    ``kept_calls``: ``session, order, ctx_gkey`` (gen key of the whole context).
    ``providers``: all calls: ``session, order, ctx_gkey, resp_h``
    (normalised hash of the response content).

    Returns ``(turns, finals)``:
    ``turns``: ``session, order, pos, generation, src_order, neutral``;
    ``finals``: ``session, order, final_generation``.
    """
    probes = kept_calls.select(session, order, F.lit(_BIG).cast("bigint").alias("pos"),
                               F.col("ctx_gkey").alias("h"), F.lit(None).cast("string").alias("content_h"),
                               F.lit(True).alias("_probe"))
    stream = (occ.select(session, order, F.col("pos").cast("bigint").alias("pos"), "h", "content_h",
                         F.lit(False).alias("_probe"))
              .unionByName(probes))
    # FIFO ranks with distributed running counts: a context repeated by a
    # third of all calls still spreads over many tasks
    stream = grouped_cumsum(stream, [session, "h"], [F.col(order), F.col("pos")],
                            {"_n": F.when(~F.col("_probe"), 1).otherwise(0)})
    prov = grouped_cumsum(
        providers.select(session, F.col(order).alias("src_order"), F.col("ctx_gkey").alias("h"), "resp_h"),
        [session, "h"], [F.col("src_order")], {"_n": F.lit(1)})
    counts = prov.groupBy(session, "h").agg(F.count(F.lit(1)).alias("_cnt"))

    turns = (stream.where(~F.col("_probe"))
             .join(prov, [session, "h", "_n"], "left")
             .select(session, order, "pos",
                     F.col("src_order").isNotNull().alias("generation"),
                     "src_order",
                     F.when(F.col("src_order").isNull(), F.lit(True))
                      .otherwise(F.col("content_h") == F.col("resp_h")).alias("neutral")))
    finals = (stream.where(F.col("_probe"))
              .join(counts, [session, "h"], "left")
              .select(session, order,
                      (F.coalesce(F.col("_cnt"), F.lit(0)) > F.col("_n")).alias("final_generation")))
    return turns, finals


# ---- E5, distributed: level-frontier replay ------------------------------------------
#
# Every occurrence of a history key has the same history length (the key
# carries it), so FIFO ranks at level L only depend on level-L keys.  Within
# a session all levels up to the first replacement that changes the history
# (a non-neutral one) are therefore final after one rank join.  Each round
# applies the decided replacements - a replacement at position q shifts every
# later prefix sum by the difference of its two md5 terms - recomputes the
# keys, ranks again, and moves the session's frontier to its next non-neutral
# level.  Rounds <= 1 + distinct non-neutral levels of a session; no session
# is ever gathered in one task.

def _sums(key: "F.Column"):
    # cast as text: beside a number it would be read as a bigint, and eight terms pass 2^63
    parts = F.split(key, ":")
    return tuple(F.when(key == "", F.lit("0")).otherwise(parts.getItem(i)).cast("decimal(38,0)") for i in (1, 2))


def kept_context_rows(kept: DataFrame) -> DataFrame:
    """Kept calls (arrays from E4) -> one row per context element with its original sums."""
    before = F.transform("gkeys", lambda x, i: F.when(i == 0, F.lit("")).otherwise(F.col("gkeys")[i - 1]))
    z = F.arrays_zip(F.col("roles").alias("role"), F.col("gshell").alias("shell"),
                     F.col("gcontent").alias("content_h"), before.alias("kb"))
    rows = kept.select("session_id", "call_order", "n_system", F.size("roles").alias("n"),
                       F.coalesce(F.try_element_at("gkeys", F.lit(-1)), F.lit("")).alias("kfull"),
                       F.posexplode(z).alias("pos", "_e"))
    b1, b2 = _sums(F.col("_e.kb"))
    f1, f2 = _sums(F.col("kfull"))
    return rows.select("session_id", "call_order", "n_system", "n", F.col("pos").cast("bigint").alias("pos"),
                       "_e.role", "_e.shell", "_e.content_h", b1.alias("ob1"), b2.alias("ob2"),
                       f1.alias("of1"), f2.alias("of2"))


def frontier_replay(ctx: DataFrame, kept: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact replay, natively.  ``ctx`` from ``kept_context_rows``; ``kept``:
    ``session_id, call_order, ctx_gkey, n`` of the kept calls (empty contexts
    included); ``providers``: ``session_id, call_order, ctx_gkey, resp_h`` of
    every call.

    Returns ``(turns, finals)`` shaped like ``mark_generation``'s.  Every
    round moves the frontier of each open session on by a level at least, so
    the loop ends.
    """
    from pyspark.sql import Window

    from ..functions.keys import EMPTY_KEY, format_key, term1, term2
    from ..session import cut_lineage

    def elem_h(shell, content_h):
        return F.md5(F.concat(shell, F.lit("|"), content_h))

    prov = grouped_cumsum(
        providers.select("session_id", F.col("call_order").alias("src_order"), F.col("ctx_gkey").alias("h"), "resp_h"),
        ["session_id", "h"], [F.col("src_order")], {"_n": F.lit(1)})
    prov = cut_lineage(prov)
    counts = prov.groupBy("session_id", "h").agg(F.max("_n").alias("_cnt"))
    spark = ctx.sparkSession
    nobody = F.lit(None)
    decided = kept.where(F.lit(False)).select(
        "session_id", "call_order", nobody.cast("bigint").alias("pos"), nobody.cast("boolean").alias("generation"),
        F.col("call_order").alias("src_order"), nobody.cast("string").alias("sub_h"))
    ctx = cut_lineage(ctx)
    f1, f2 = _sums(F.col("ctx_gkey"))
    kept = cut_lineage(kept.select("session_id", "call_order", "n", f1.alias("of1"), f2.alias("of2")))
    open_sessions = cut_lineage(kept.select("session_id").distinct().withColumn("_front", F.lit(-1).cast("bigint")))
    finals_out = []
    while not open_sessions.isEmpty():
        c = ctx.join(open_sessions, "session_id", "left_semi").join(
            decided.select("session_id", "call_order", "pos", "generation", "sub_h"),
            ["session_id", "call_order", "pos"], "left")
        sub = F.col("generation") & F.col("sub_h").isNotNull()
        c = c.withColumn("_d1", F.when(sub, term1(F.col("pos"), elem_h(F.col("shell"), F.col("sub_h")))
                                     - term1(F.col("pos"), elem_h(F.col("shell"), F.col("content_h")))).otherwise(0)
                         .cast("decimal(38,0)"))
        c = c.withColumn("_d2", F.when(sub, term2(F.col("pos"), elem_h(F.col("shell"), F.col("sub_h")))
                                     - term2(F.col("pos"), elem_h(F.col("shell"), F.col("content_h")))).otherwise(0)
                         .cast("decimal(38,0)"))
        # shifts before each position within the call (a call is one row's worth: bounded window)
        wc = Window.partitionBy("session_id", "call_order").orderBy("pos")
        c = (c.withColumn("_cd1", F.sum("_d1").over(wc.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("_cd2", F.sum("_d2").over(wc.rowsBetween(Window.unboundedPreceding, -1))))
        tot = c.groupBy("session_id", "call_order").agg(F.sum("_d1").alias("_td1"), F.sum("_d2").alias("_td2"))
        h = F.when(F.col("pos") == 0, F.lit(EMPTY_KEY)).otherwise(format_key(
            F.col("pos"), F.col("ob1") + F.coalesce(F.col("_cd1"), F.lit(0)),
            F.col("ob2") + F.coalesce(F.col("_cd2"), F.lit(0))))
        occ = c.where((F.col("role") == "assistant") & (F.col("pos") >= F.col("n_system"))).select(
            "session_id", "call_order", "pos", h.alias("h"), "content_h", F.lit(False).alias("_probe"))
        fk = F.when(F.col("n") == 0, F.lit(EMPTY_KEY)).otherwise(format_key(
            F.col("n"), F.col("of1") + F.coalesce(F.col("_td1"), F.lit(0)),
            F.col("of2") + F.coalesce(F.col("_td2"), F.lit(0))))
        probes = (kept.join(open_sessions, "session_id", "left_semi")
                  .join(tot, ["session_id", "call_order"], "left")
                  .select("session_id", "call_order", F.lit(_BIG).cast("bigint").alias("pos"), fk.alias("h"),
                          F.lit(None).cast("string").alias("content_h"), F.lit(True).alias("_probe")))
        stream = cut_lineage(grouped_cumsum(
            occ.unionByName(probes), ["session_id", "h"], [F.col("call_order"), F.col("pos")],
            {"_n": F.when(~F.col("_probe"), 1).otherwise(0)}))
        t = (stream.where(~F.col("_probe")).join(prov, ["session_id", "h", "_n"], "left")
             .select("session_id", "call_order", "pos", F.col("src_order").isNotNull().alias("generation"),
                     "src_order", F.when(F.col("src_order").isNotNull(), F.col("resp_h")).alias("sub_h"),
                     (F.col("src_order").isNotNull() & (F.col("resp_h") != F.col("content_h"))).alias("_nn")))
        t = cut_lineage(t.join(open_sessions, "session_id"))
        nxt = (t.where(F.col("_nn") & (F.col("pos") > F.col("_front")))
               .groupBy("session_id").agg(F.min("pos").alias("_new_front")))
        front = cut_lineage(open_sessions.join(nxt, "session_id", "left"))
        t = t.join(front.select("session_id", "_new_front"), "session_id")
        newly = t.where((F.col("pos") > F.col("_front"))
                        & (F.col("_new_front").isNull() | (F.col("pos") <= F.col("_new_front"))))
        # only the new rows are written; the frames of all rounds are read as one
        decided = decided.unionByName(cut_lineage(
            newly.select("session_id", "call_order", "pos", "generation", "src_order", "sub_h")))
        done = front.where(F.col("_new_front").isNull()).select("session_id")
        fin = (stream.where(F.col("_probe")).join(done, "session_id", "left_semi")
               .join(counts, ["session_id", "h"], "left")
               .select("session_id", "call_order",
                       (F.coalesce(F.col("_cnt"), F.lit(0)) > F.col("_n")).alias("final_generation")))
        finals_out.append(cut_lineage(fin))
        open_sessions = cut_lineage(front.where(F.col("_new_front").isNotNull())
                                    .select("session_id", F.col("_new_front").alias("_front")))
    turns = decided.select(
        "session_id", "call_order", "pos", "generation", "src_order")
    finals = finals_out[0] if finals_out else spark.createDataFrame([], "session_id string")
    for f in finals_out[1:]:
        finals = finals.unionByName(f)
    return turns, finals
