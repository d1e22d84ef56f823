"""Merge: hand-written expected rows, and properties of invented random logs."""

import json
from collections import Counter

from fixtures import canon, make_log, write_log
from pyspark.sql import functions as F

from relaytrace.plans.merge import merge_calls, write_trajectories
from relaytrace.sources.calls import read_trajectories


def _rows(traj):
    js = traj.select(F.to_json(F.struct("meta", "tools", "messages")).alias("j")).collect()
    return [canon(json.loads(x.j)) for x in js]


def _merged(spark, path, lines, **kw):
    write_log(path, lines, n_files=1)
    return merge_calls(spark, path, **kw)


def _text(t):
    return {"type": "text", "text": t}


def _says(t, *more):
    return {"role": "assistant", "content": [_text(t), *more]}


def _asks(t):
    return {"role": "user", "content": t}


def _call(t, messages, response, session="s", **body):
    return {"session_id": session, "biz_id": "b", "request_time": t,
            "request_body": {"messages": messages, "model": "m", "max_tokens": 9, **body},
            "response_body": {"content": response}}


def _tool_session():
    """Three calls of one growing context: two tools answered in reverse, then plain talk."""
    use_a = {"type": "tool_use", "id": "A", "name": "read", "input": {"x": 1}}
    use_b = {"type": "tool_use", "id": "B", "name": "run", "input": {"y": [2.5, None]}}
    use_c = {"type": "tool_use", "id": "C", "name": "read", "input": {}}
    tools = [{"name": "read", "description": "Read", "input_schema": {"properties": {"x": {}}, "required": ["x"], "$id": 1}},
             {"name": "run", "input_schema": {}}]
    body = {"system": "You help.", "tools": tools, "metadata": {"user": "u", "model": "other", "deep": {"k": [1]}}}

    def think(t):
        return {"type": "thinking", "thinking": t, "signature": "z"}

    first = [{"role": "user", "content": [_text("q1")]}]
    second = [*first, _says("t1", use_a, use_b),
              {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "B", "content": "rb"},
                                           {"type": "tool_result", "tool_use_id": "A", "content": [_text("ra")]}, _text("hurry")]}]
    third = [*second, _says("t2"), _asks("go on")]
    calls = [_call(1, first, [think("p1"), _text("t1"), use_a, use_b], **body),
             _call(2, second, [think("p2"), _text("t2")], **body), _call(3, third, [think("p3"), use_c], **body)]
    calls[1]["request_body"] = json.dumps(calls[1]["request_body"])
    return [json.dumps(c) for c in calls]


def test_whole_row(spark, tmpdir_run):
    res = _merged(spark, f"{tmpdir_run}/in", _tool_session())
    (row,) = _rows(res.trajectories)
    assert res.rejects.count() == 0
    assert row["messages"] == [canon(m) for m in (
        {"role": "system", "content": [{"type": "text", "text": "You help."}]},
        {"role": "user", "content": "q1"},
        {"role": "assistant", "content": "t1", "reasoning_content": "p1", "generation": True, "tool_calls": [
            {"name": "read", "arguments": {"x": 1}}, {"name": "run", "arguments": {"y": [2.5, None]}}]},
        {"role": "tool", "tool_name": "read", "content": [{"type": "text", "text": "ra"}]},
        {"role": "tool", "tool_name": "run", "content": "rb"},
        {"role": "user", "content": "hurry"},
        {"role": "assistant", "content": "t2", "reasoning_content": "p2", "generation": True},
        {"role": "user", "content": "go on"},
        {"role": "assistant", "content": "", "reasoning_content": "p3", "generation": True,
         "tool_calls": [{"name": "read", "arguments": {}}]})]
    assert row["tools"] == [canon(t) for t in (
        {"type": "function", "function": {"name": "read", "description": "Read", "parameters": {
            "type": "object", "properties": {"x": {}}, "required": ["x"]}}},
        {"type": "function", "function": {"name": "run", "description": "", "parameters": {"type": "object", "properties": {}}}})]


def test_metadata_overlay(spark, tmpdir_run):
    """The caller's metadata are keys of ``meta`` in the files; the four own keys win."""
    res = _merged(spark, f"{tmpdir_run}/in", _tool_session())
    write_trajectories(res.trajectories, f"{tmpdir_run}/out", single_file=True)
    (line,) = spark.read.text(f"{tmpdir_run}/out").collect()
    want = {"user": "u", "deep": {"k": [1]}, "session_id": "s", "biz_id": "b", "model": "m", "max_tokens": 9}
    assert json.loads(line.value)["meta"] == want
    (back,) = read_trajectories(spark, f"{tmpdir_run}/out").collect()
    assert back.session_id == "s" and json.loads(back.meta.toJson()) == want


def _talk(row):
    return [(m["role"][0], m["content"], m.get("generation")) for m in row["messages"]]


def test_retry_takes_responses_in_order(spark, tmpdir_run):
    """Two answers to one context: the echo of the second takes the first, after
    which the history is no logged context any more."""
    lines = [_call(1, [_asks("u")], [_text("a1")]), _call(2, [_asks("u")], [_text("a2")]),
             _call(3, [_asks("u"), _says("a2"), _asks("v")], [_text("b1")])]
    res = _merged(spark, f"{tmpdir_run}/in", [json.dumps(x) for x in lines], min_assistant_turns=1)
    assert [_talk(r) for r in _rows(res.trajectories)] == [
        [("u", "u", None), ("a", "a1", True), ("u", "v", None), ("a", "b1", False)]]


def test_frontier_replay_needs_three_rounds(spark, tmpdir_run):
    """A replacement at level 1 makes the history match a later retried context,
    whose replacement is again non-neutral (level 3): rounds 1, 2, 3."""
    u0, u1, u2 = _asks("start"), _asks("go on"), _asks("more")
    lines = [_call(10, [u0], [_text("a1")]), _call(20, [u0], [_text("a2")]),
             _call(25, [u0, _says("a2"), u1, _says("x"), u2], [_text("k")]),
             _call(30, [u0, _says("a1"), u1], [_text("b1")]), _call(40, [u0, _says("a1"), u1], [_text("b2")])]
    res = _merged(spark, f"{tmpdir_run}/in", [json.dumps(x) for x in lines], min_assistant_turns=1)
    got = sorted(map(_talk, _rows(res.trajectories)), key=len)
    assert got == [
        [("u", "start", None), ("a", "a2", True), ("u", "go on", None), ("a", "b2", False)],
        [("u", "start", None), ("a", "a1", True), ("u", "go on", None), ("a", "b1", True), ("u", "more", None), ("a", "k", False)]]


def test_every_reject_has_its_reason(spark, tmpdir_run):
    two = [{"type": "thinking", "thinking": "a"}, {"type": "thinking", "thinking": "b"}]
    odd = {"null_text": [{"role": "user", "content": [{"type": "text", "text": None}]}],
           "string_turn": [_asks("q"), {"role": "assistant", "content": "said"}, _asks("r")],
           "two_thoughts": [_asks("q"), {"role": "assistant", "content": two}, _asks("r")],
           "loose_block": [_asks("q"), _says("a"), {"role": "user", "content": ["loose"]}],
           "no_object": ["text"], "odd_role": [{"role": 5, "content": "q"}], "short": [_asks("q")]}
    lines = [json.dumps(_call(1, m, [], session=s)) for s, m in odd.items()] + ["{cut", json.dumps({"session_id": "x", "request_body": {}})]
    res = _merged(spark, f"{tmpdir_run}/in", lines)
    assert res.trajectories.count() == 0
    got = Counter(r.reason.split(":")[0] for r in res.rejects.collect())
    assert got == {"bad_context": 3, "assistant_string": 1, "multi_thinking": 1, "bad_block": 1, "few_turns": 1,
                   "bad_json": 1, "bad_body": 1}


def _request(rec):
    body = rec["request_body"]
    return json.loads(body) if isinstance(body, str) else body


def test_random_logs(spark, tmpdir_run):
    """What holds for any log: no answer is used twice, the longest context of a
    session survives; without a retry all tool messages follow the order of the
    calls (after one, the answers belong to calls that the replay replaced)."""
    for seed in (7, 11):
        lines = make_log(seed=seed, n_sessions=14)
        write_log(f"{tmpdir_run}/in{seed}", lines)
        rows = _rows(merge_calls(spark, f"{tmpdir_run}/in{seed}").trajectories)
        turns: dict[str, int] = {}
        for line in lines:
            if "claude-sonnet" in line:
                rec = json.loads(line)
                n = 1 + sum(m["role"] == "assistant" for m in _request(rec)["messages"])
                turns[rec["session_id"]] = max(n, turns.get(rec["session_id"], 0))
        longest: dict[str, int] = {}
        used = Counter()
        strict = {s for s in turns if not any(f"plan {s} {t} 1 " in line for line in lines for t in range(turns[s]))}
        assert strict
        for row in rows:
            said = [m for m in row["messages"] if m["role"] == "assistant"]
            sid = row["meta"]["session_id"]
            longest[sid] = max(len(said), longest.get(sid, 0))
            used.update((sid, m["reasoning_content"]) for m in said if m["generation"])
            assert row["messages"][0]["role"] == "system" and row["messages"][-1]["role"] == "assistant"
            assert all(m["reasoning_content"].startswith(f"plan {sid} ") for m in said if m["generation"])
            assert not any(m["reasoning_content"] for m in said[:-1] if not m["generation"])
            open_calls: list[str] = []
            for m in row["messages"]:
                if sid not in strict:
                    break
                if m["role"] == "assistant":
                    assert not open_calls
                    open_calls = [c["name"] for c in m.get("tool_calls", [])]
                elif m["role"] == "tool" and m["tool_name"] in ("read_file", "run"):
                    assert open_calls.pop(0) == m["tool_name"]
        assert longest == {s: n for s, n in turns.items() if n >= 3}
        assert used and max(used.values()) == 1
