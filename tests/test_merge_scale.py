"""What large logs need: bounded worker memory, work only where calls share a
session, lines read once, sums of long contexts."""

import json

from pyspark.sql import functions as F

from relaytrace.functions import canonical, keys
from relaytrace.plans import merge
from relaytrace.sources.conversations import conversation_raw_log
from relaytrace.streaming.jobs import _session_of

LINES = "value string, src_file string, src_block bigint, src_ord bigint"


def test_f1_remembered_elements_are_bounded(monkeypatch):
    monkeypatch.setattr(canonical, "_elements_seen", {})
    most = 0
    for i in range(70_000):
        canonical._element(f'{{"role":"user","content":"{i}"}}')
        most = max(most, len(canonical._elements_seen))
    assert most <= 1 << 16
    assert keys._py_term.cache_info().maxsize <= 1 << 15


def call(session, time, texts, done="done"):
    turns = [{"role": "user" if i % 2 == 0 else "assistant", "content": t if i % 2 == 0 else [{"type": "text", "text": t}]} for i, t in enumerate(texts)]
    return json.dumps({"session_id": session, "request_time": time, "request_body": {"messages": turns},
                       "response_body": {"content": [{"type": "text", "text": done}]}})


def test_f2_only_calls_that_share_a_session_are_compared(spark, monkeypatch):
    lines = [call(f"lone{i}", i, ["a", "b", "c", "d", f"e{i}"]) for i in range(9)] + [call("empty", 1, [])]
    lines += [call("two", 1, ["a"], "b"), call("two", 2, ["a", "b", "c"], "other"), call("two", 3, ["a", "b", "c", "d", "e"])]
    lines += [call("same", 4, ["a", "b", "c", "d", "e"], x) for x in ("x", "y")]
    df = spark.createDataFrame([(x, "f", 0, i) for i, x in enumerate(lines)], LINES)
    seen = []
    real = merge.prefix_dedup
    monkeypatch.setattr(merge, "prefix_dedup", lambda ctx, calls, *a: seen.append(calls) or real(ctx, calls, *a))

    def rows(res):
        cols = [c for c in res.trajectories.columns if c != "call_order"]
        return (sorted(str(r) for r in res.trajectories.select(F.to_json(F.struct(*cols))).collect()),
                sorted(str(r) for r in res.rejects.collect()), sorted((r.session_id, r.call_order.src_ord) for r in res.kept.collect()))

    now = rows(merge.merge_lines(df, min_assistant_turns=1))
    assert {r.session_id for r in seen[0].collect()} == {"two", "same"}
    monkeypatch.setattr(merge, "_several_calls", lambda calls: None)
    assert now == rows(merge.merge_lines(df, min_assistant_turns=1))
    assert len(now[0]) == 12


def test_f3_session_of_a_line_reads_it_once(spark):
    odd = ['{"session_id":"s"}', "{}", '{"session_id":5}', '{"session_id":null}', '{"session_id":["s"]}', "{bad", '"text"', '{"session_id":"s","a":{"session_id":1}}']
    df = spark.createDataFrame([(x,) for x in odd], "value string").select("value", _session_of(F.col("value")).alias("s"))
    assert [r.s for r in df.collect()] == ["s", "", None, None, None, None, "", "s"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_f4_long_contexts_of_retried_sessions(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}" + "\nmore" * (i == 3)) for i in range(24)]
    conv = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    log = conversation_raw_log(conv, retry_when=F.instr("text", "\n") > 0, first_try_suffix=" (first try)")
    [row] = merge.merge_lines(log).trajectories.select("n_assistant", F.col("messages")[3]["content"].cast("string").alias("third"),
                                                       F.size(F.filter("messages", lambda m: m["generation"])).alias("generated")).collect()
    # the first answer comes back in the third turn, so that later histories are not found again
    assert (row.n_assistant, row.third, row.generated) == (12, "turn 3\nmore (first try)", 2)
