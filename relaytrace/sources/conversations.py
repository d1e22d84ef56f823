"""A call log derived from the ``conversations`` table.

Each assistant turn ``t`` of a conversation becomes one logged call: its
context is every earlier turn of the conversation (system turns as system
blocks), its response is turn ``t`` and its ``request_time`` is ``10*t``.
Optional *retries* re-log a call 5 ms later with the same context, and
optional *lost* calls are left out of the log.  Both are given as predicates
on the assistant row; they shape the log, they never filter the input.

Produced frames (all keyed by ``session_id`` = ``conv_id``):

* ``elements``: one row per conversation turn with its element hash and the
  running prefix key (``functions.keys``);
* ``calls``: one row per logged call (``call_order`` = request time);
* ``ctx``: one row per (call, context element), the exploded log, as the
  raw-JSON path produces it from each call's own context.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import EMPTY_KEY, format_key, grouped_cumsum, term1, term2


@dataclass
class CallLog:
    elements: DataFrame
    calls: DataFrame
    ctx: DataFrame


def element_hash(role: Column, text: Column) -> Column:
    """Canonical element text is the JSON object ``{"content": text, "role": role}``."""
    return F.md5(F.to_json(F.struct(text.alias("content"), role.alias("role"))))


def conversation_call_log(conv: DataFrame, retry_when: Column | None = None,
                          lost_when: Column | None = None) -> CallLog:
    e = conv.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("pos"),
                    "role", "text")
    e = e.withColumn("elem_h", element_hash(F.col("role"), F.col("text")))
    # one distributed running sum gives the prefix keys (two md5 terms) and the
    # count of earlier assistant turns
    pos, h = F.col("pos"), F.col("elem_h")
    e = (e.withColumn("_a", F.when(F.col("role") == "assistant", 1).otherwise(0))
          .withColumn("_t1", term1(pos, h)).withColumn("_t2", term2(pos, h)))
    e = grouped_cumsum(e, ["session_id"], [pos], {"_s1": F.col("_t1"), "_s2": F.col("_t2"),
                                                  "_a_upto": F.col("_a")})
    e = (e.withColumn("key", format_key(pos + 1, F.col("_s1"), F.col("_s2")))
          .withColumn("key_before", F.when(pos == 0, F.lit(EMPTY_KEY)).otherwise(
              format_key(pos, F.col("_s1") - F.col("_t1"), F.col("_s2") - F.col("_t2"))))
          .withColumn("n_asst_before", (F.col("_a_upto") - F.col("_a")).cast("bigint"))
          .drop("_a", "_t1", "_t2", "_s1", "_s2", "_a_upto"))
    last = (e.where(F.col("role") == "assistant").groupBy("session_id")
            .agg(F.max("pos").alias("last_call_turn")))
    e = e.join(last, "session_id", "left")

    base = e.where(F.col("role") == "assistant")
    if lost_when is not None:
        base = base.where(~F.coalesce(lost_when, F.lit(False)))
    base = base.withColumn("_retry", F.coalesce(retry_when, F.lit(False)) if retry_when is not None
                           else F.lit(False))
    calls = base.select(
        "session_id", F.col("pos").alias("call_turn"), (F.col("pos") * 10).alias("request_time"),
        F.col("pos").alias("ctx_len"), "n_asst_before",
        F.col("key_before").alias("ctx_key"), F.col("text").alias("response"),
        F.md5(F.col("text")).alias("resp_h"), F.lit(False).alias("is_retry"), "_retry")
    retries = (calls.where(F.col("_retry"))
               .withColumn("request_time", F.col("request_time") + 5)
               .withColumn("is_retry", F.lit(True)))
    calls = calls.unionByName(retries).drop("_retry").withColumn("call_order", F.col("request_time"))

    # exploded log: element at pos belongs to every call at a later turn
    seq = F.when(F.col("pos") < F.col("last_call_turn"),
                 F.sequence(F.col("pos") + 1, F.col("last_call_turn"))).otherwise(F.array().cast("array<bigint>"))
    spread = e.select("session_id", "pos", "role", "key", "key_before",
                      F.md5(F.col("text")).alias("content_h"), F.explode(seq).alias("call_turn"))
    ctx = spread.join(calls.select("session_id", "call_turn", "call_order"), ["session_id", "call_turn"])
    return CallLog(e, calls, ctx)


def retried(col_text: Column) -> Column:
    """Default retry rule for fixtures: the response spans several lines."""
    return F.instr(col_text, "\n") > 0


__all__ = ["CallLog", "conversation_call_log", "element_hash", "EMPTY_KEY", "retried"]


def conversation_raw_log(conv: DataFrame, retry_when: Column | None = None,
                         first_try_suffix: str = " (first try)") -> DataFrame:
    """Raw JSONL call records (one per assistant turn) built by Spark from ``conversations``.

    Context = earlier turns (a system turn becomes the system prompt, user
    turns string content, assistant turns echoed as one text block).  With
    ``retry_when`` (a predicate on the assistant row) the turn is first
    answered differently (text + suffix) and then retried 5 ms later with
    the answer the conversation continued from, which makes the session
    non-neutral for the replay.  Output: ``value, src_file, src_block,
    src_ord`` like the text scan.
    """
    e = conv.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("pos"), "role", "text")
    last = (e.where(F.col("role") == "assistant").groupBy("session_id")
            .agg(F.max("pos").alias("last_call_turn")))
    # every earlier turn belongs to the context of each later assistant turn
    seq = F.when(F.col("pos") < F.col("last_call_turn"),
                 F.sequence(F.col("pos") + 1, F.col("last_call_turn"))).otherwise(F.array().cast("array<bigint>"))
    spread = e.join(last, "session_id").select("session_id", "pos", "role", "text",
                                                F.explode(seq).alias("call_turn"))
    asst_turns = e.where(F.col("role") == "assistant").select("session_id", F.col("pos").alias("call_turn"))
    ctx = spread.join(asst_turns, ["session_id", "call_turn"])
    blk = F.to_variant_object(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    msg = F.when(F.col("role") == "assistant",
                 F.to_variant_object(F.struct(F.lit("assistant").alias("role"), blk.alias("content"))))\
        .otherwise(F.to_variant_object(F.struct(F.col("role").alias("role"),
                                                F.col("text").cast("variant").alias("content"))))
    per_call = (ctx.groupBy("session_id", "call_turn")
                .agg(F.array_sort(F.collect_list(F.struct(
                    "pos",
                    F.when(F.col("role") != "system", msg).alias("m"),
                    F.when(F.col("role") == "system", F.col("text")).alias("sys"))),
                    lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
                     .alias("_c")))
    calls = e.where(F.col("role") == "assistant").select(
        "session_id", F.col("pos").alias("call_turn"), "text",
        (F.coalesce(retry_when, F.lit(False)) if retry_when is not None else F.lit(False)).alias("_retry"))
    calls = calls.join(per_call, ["session_id", "call_turn"], "left")
    messages = F.filter(F.transform(F.coalesce(F.col("_c"), F.array()), lambda x: x["m"]), lambda m: m.isNotNull())
    system = F.try_element_at(F.filter(F.transform(F.coalesce(F.col("_c"), F.array()), lambda x: x["sys"]),
                                       lambda s: s.isNotNull()), F.lit(1))

    def record(resp_text, t_offset):
        sys_v = F.when(system.isNull(), F.parse_json(F.lit("[]"))).otherwise(system.cast("variant"))
        body = F.struct(sys_v.alias("system"), messages.alias("messages"),
                        F.array().cast("array<variant>").alias("tools"), F.lit("model-x").alias("model"),
                        F.lit(1024).alias("max_tokens"))
        resp = F.struct(F.array(F.struct(F.lit("text").alias("type"), resp_text.alias("text"))).alias("content"))
        return F.to_json(F.struct(F.col("session_id").cast("string").alias("session_id"),
                                  F.lit("").alias("biz_id"),
                                  (F.col("call_turn") * 10 + t_offset).alias("request_time"),
                                  body.alias("request_body"), resp.alias("response_body")))

    first = calls.select(F.when(F.col("_retry"), record(F.concat(F.col("text"), F.lit(first_try_suffix)), 0))
                         .otherwise(record(F.col("text"), 0)).alias("value"), "session_id", "call_turn")
    retry = calls.where(F.col("_retry")).select(record(F.col("text"), 5).alias("value"), "session_id", "call_turn")
    return (first.unionByName(retry)
            .select("value", F.concat(F.lit("conv-"), F.col("session_id").cast("string")).alias("src_file"),
                    F.lit(0).cast("bigint").alias("src_block"),
                    (F.col("call_turn") * 2).cast("bigint").alias("src_ord")))
