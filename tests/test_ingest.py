"""Collect stage: provider events -> raw call rows; loaders; raw-call ingest stream."""

import json
import os

from pyspark.sql import functions as F

from relaytrace.operators.ingest import normalize_provider_events
from relaytrace.plans.merge import merge_calls
from relaytrace.sources.calls import encode_calls, read_cases, read_lines, read_trajectories, parse_calls
from relaytrace.streaming.jobs import ingest_calls, ingest_provider_events, read_ingested

EV_SCHEMA = ("ts string, success boolean, model string, max_tokens bigint, optional_params string, "
             "system string, messages string, tools string, choices string")


def _events(spark, rows):
    df = spark.createDataFrame(rows, EV_SCHEMA)
    for c in ("optional_params", "system", "messages", "tools", "choices"):
        df = df.withColumn(c, F.try_parse_json(c))
    return df


def test_provider_events(spark):
    msgs = json.dumps([{"role": "user", "content": "hi"}])
    choice = lambda m: json.dumps([{"message": m}])
    rows = [
        ("2024-01-01 00:00:05", True, "claude-sonnet", None, json.dumps({"system": "sys A", "max_tokens": 100}),
         None, msgs, json.dumps([{"type": "function", "function": {"name": "f", "description": "d",
                                                                   "parameters": {"type": "object"}}}]),
         choice({"content": "answer", "thinking_blocks": [{"thinking": "t1"}, {"thinking": "t2"}],
                 "tool_calls": [{"id": "c1", "function": {"name": "f", "arguments": "{\"x\": 1}"}},
                                {"id": "c2", "function": {"name": "g", "arguments": "not json"}}]})),
        ("2024-01-01 00:00:01", True, "m", 50, "{}", json.dumps([{"type": "text", "text": "s"}]), msgs,
         json.dumps([{"name": "h", "input_schema": {"properties": {}}}]), "[]"),
        ("2024-01-01 00:10:00", True, "m", None, None, "42", msgs, None, choice({"content": None})),
        ("2024-01-01 00:10:01", False, "m", None, None, None, msgs, None, "[]"),
        ("2024-01-01 00:10:02", True, "claude-HAIKU", None, None, None, msgs, None, "[]"),
    ]
    ev = _events(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    ann = spark.createDataFrame([("2024-01-01 00:00:02", "case-1"), ("2024-01-01 00:05:00", "case-2")],
                                "ts string, instance_id string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = normalize_provider_events(ev, ann, extra_cols={"tag": F.lit("x")}).orderBy("request_time").collect()
    assert len(out) == 3  # failed and excluded events dropped
    recs = [json.loads(r.value) for r in out]
    assert [r["session_id"] for r in recs] == ["unknown", "case-1", "case-2"]
    first, second, third = recs
    assert first["request_body"]["system"] == [{"type": "text", "text": "s"}]
    assert first["request_body"]["max_tokens"] == 50
    assert first["response_body"]["content"] == []
    assert first["request_body"]["tools"] == [{"name": "h", "description": "", "input_schema": {"properties": {}}}]
    assert second["request_body"]["system"] == [{"type": "text", "text": "sys A"}]
    assert second["request_body"]["max_tokens"] == 100
    assert second["request_body"]["tools"][0] == {"name": "f", "description": "d", "input_schema": {"type": "object"}}
    blocks = second["response_body"]["content"]
    assert [b["type"] for b in blocks] == ["thinking", "thinking", "text", "tool_use", "tool_use"]
    assert blocks[3]["input"] == {"x": 1} and blocks[4]["input"] == {"raw": "not json"}
    assert out[1].content_types == ["thinking", "thinking", "text", "tool_use", "tool_use"]
    assert third["request_body"]["system"] == [] and third["request_body"]["max_tokens"] == 8192
    assert third["response_body"]["content"] == [] and second["tag"] == "x"


def test_loaders_and_encode(spark, tmpdir_run):
    cases = [{"instance_id": "a", "checklist": {"c": {"checks": []}}, "scaffold": {"name": "droid"}},
             {"instance_id": "b", "user_query": ["q"]},
             {"instance_id": "a", "checklist": {"d": {"checks": [{"check_id": "x"}]}}}]
    os.makedirs(f"{tmpdir_run}/cases", exist_ok=True)
    with open(f"{tmpdir_run}/cases/c.jsonl", "w") as fh:
        fh.write("\n".join(json.dumps(c) for c in cases) + "\n\n")
    got = {r.instance_id: r for r in read_cases(spark, f"{tmpdir_run}/cases").collect()}
    assert set(got) == {"a", "b"}
    assert json.loads(got["a"].checklist.toJson()) == {"d": {"checks": [{"check_id": "x"}]}}

    os.makedirs(f"{tmpdir_run}/traj", exist_ok=True)
    for name, sid in (("s1.jsonl", "x"), ("s2.jsonl", "")):
        with open(f"{tmpdir_run}/traj/{name}", "w") as fh:
            fh.write(json.dumps({"meta": {"session_id": sid}, "tools": [], "messages": []}) + "\n")
    by_meta = {r.session_id for r in read_trajectories(spark, f"{tmpdir_run}/traj", "file").collect()}
    by_file = {r.session_id for r in read_trajectories(spark, f"{tmpdir_run}/traj", "dir").collect()}
    assert by_meta == {"x"} and by_file == {"s1", "s2"}

    line = {"session_id": "s", "biz_id": "b", "request_time": 3,
            "request_body": {"messages": [{"role": "user", "content": "q"}], "system": [], "tools": [],
                             "model": "m", "max_tokens": 5, "metadata": {}},
            "response_body": {"content": [{"type": "text", "text": "a"}]}}
    os.makedirs(f"{tmpdir_run}/raw", exist_ok=True)
    with open(f"{tmpdir_run}/raw/x.jsonl", "w") as fh:
        fh.write(json.dumps(line) + "\n")
    calls, _ = parse_calls(read_lines(spark, f"{tmpdir_run}/raw"))
    assert json.loads(encode_calls(calls).first().value) == line


def test_ingest_calls_stream(spark, tmpdir_run):
    os.makedirs(f"{tmpdir_run}/in/a", exist_ok=True)
    good = {"session_id": "s", "request_time": 1, "request_body": {"messages": [], "model": "m"},
            "response_body": {"content": []}}
    with open(f"{tmpdir_run}/in/a/x.jsonl", "w") as fh:
        fh.write("\n".join([json.dumps(good), "{bad", json.dumps({**good, "meta": {"model": "haiku-3"}})]) + "\n")
    ingest_calls(spark, f"{tmpdir_run}/in/*", f"{tmpdir_run}/out", f"{tmpdir_run}/ck").awaitTermination()
    rows = read_ingested(spark, f"{tmpdir_run}/out").collect()
    assert [(r.session_id, r.request_time) for r in rows] == [("s", 1)]
    bad = read_ingested(spark, f"{tmpdir_run}/out", "rejects").collect()
    assert [(r.stage, r.reason, r.raw, r.epoch) for r in bad] == [("parse", "bad_json", "{bad", 0)]
    # the ingested lines feed the merge unchanged
    assert merge_calls(spark, f"{tmpdir_run}/in/a", min_assistant_turns=1).trajectories.count() == 1


def test_ingest_provider_events_stream(spark, tmpdir_run):
    os.makedirs(f"{tmpdir_run}/ev/a", exist_ok=True)
    event = {"ts": "2024-01-01T10:00:00Z", "success": True, "model": "m", "messages": [{"role": "user", "content": "hi"}],
             "choices": [{"message": {"content": "yes", "tool_calls": []}}]}
    lines = [event, {**event, "ts": "2024-01-01T12:00:00Z", "max_tokens": 7}, {**event, "success": False}, {**event, "model": "a-haiku"},
             {**event, "ts": None}, {**event, "success": "x"}, [1]]
    with open(f"{tmpdir_run}/ev/a/x.jsonl", "w") as fh:
        fh.write("\n".join([*map(json.dumps, lines), "{no"]) + "\n")
    ann = spark.sql("SELECT TIMESTAMP'2024-01-01 11:00:00Z' AS ts, 'run 1' AS instance_id")
    ingest_provider_events(spark, f"{tmpdir_run}/ev/*", f"{tmpdir_run}/eout", f"{tmpdir_run}/eck", ann).awaitTermination()
    calls = sorted((r.session_id, r.request_time, json.loads(r.value)) for r in read_ingested(spark, f"{tmpdir_run}/eout").collect())
    assert [(s, t) for s, t, _ in calls] == [("run 1", 1704110400000), ("unknown", 1704103200000)]
    assert [v["request_body"]["max_tokens"] for _, _, v in calls] == [7, 8192]
    assert calls[0][2]["response_body"]["content"] == [{"type": "text", "text": "yes"}]
    bad = sorted((r.stage, r.reason, r.raw) for r in read_ingested(spark, f"{tmpdir_run}/eout", "rejects").collect())
    assert [x[:2] for x in bad] == [("event", "bad_event")] * 2 + [("event", "bad_json")] * 2


def test_cli_merge_then_score(spark, tmpdir_run):
    from fixtures import make_log, write_log
    from relaytrace.cli import main
    write_log(f"{tmpdir_run}/logs", make_log(seed=9, n_sessions=8))
    main(["merge", "--input_path", f"{tmpdir_run}/logs", "--output_path", f"{tmpdir_run}/traj",
          "--chunk_size", "3"])
    import glob
    parts = [p for p in glob.glob(f"{tmpdir_run}/traj/*.json")]
    assert all(sum(1 for _ in open(p)) <= 3 for p in parts)
    traj = spark.read.json(f"{tmpdir_run}/traj")
    sessions = [r.sid for r in traj.select(F.col("meta.session_id").alias("sid")).distinct().collect()]
    assert sessions
    with open(f"{tmpdir_run}/cases.jsonl", "w") as fh:
        for sid in sessions + ["nope"]:
            fh.write(json.dumps({"instance_id": sid, "checklist": {"A": {"checks": [{"check_id": "c"}]}}}) + "\n")
    with open(f"{tmpdir_run}/resp.jsonl", "w") as fh:
        for sid in sessions:
            fh.write(json.dumps({"instance_id": sid, "response": json.dumps(
                {"A": {"checks": [{"check_id": "c", "result": "success"}]}})}) + "\n")
    main(["score", "--trajectories", f"{tmpdir_run}/traj", "--data", f"{tmpdir_run}/cases.jsonl",
          "--output", f"{tmpdir_run}/report", "--responses", f"{tmpdir_run}/resp.jsonl"])
    summary = spark.read.json(f"{tmpdir_run}/report/summary").first()
    assert summary.total == len(sessions) and summary.pass_count == len(sessions)
    assert [r.instance_id for r in spark.read.json(f"{tmpdir_run}/report/missing").collect()] == ["nope"]
