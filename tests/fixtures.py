"""Invented raw call logs for tests (agent sessions with tools and thinking)."""

from __future__ import annotations

import copy
import json
import random

TOOLS = [
    {"name": "read_file", "description": "Read a file", "input_schema": {
        "type": "object", "properties": {"path": {"type": "string"}}, "required": ["path"]}},
    {"name": "run", "description": "Run a command", "input_schema": {
        "type": "object", "properties": {"cmd": {"type": "string"}}}},
]


def _resp(rng: random.Random, sid: str, turn: int, variant: int = 0, tools: bool = True) -> list:
    blocks = [{"type": "thinking", "thinking": f"plan {sid} {turn} {variant} ☃", "signature": f"sig{turn}"}]
    if rng.random() < 0.8:
        blocks.append({"type": "text", "text": f"step {turn}.{variant} for {sid} — naïve 😀"})
    if tools and rng.random() < 0.7:
        for j in range(rng.choice([1, 1, 2, 3])):
            blocks.append({"type": "tool_use", "id": f"tu_{sid}_{turn}_{variant}_{j}",
                           "name": rng.choice(["read_file", "run"]),
                           "input": {"path": f"/p/{turn}/{j}", "n": 1.0 if j else 2, "cache_control": {"x": 1}}})
    return blocks


def _echo(blocks: list) -> list:
    """What a client sends back: the response without thinking blocks."""
    return [copy.deepcopy(b) for b in blocks if b["type"] != "thinking"]


def _results(rng: random.Random, blocks: list) -> list:
    ids = [b["id"] for b in blocks if b["type"] == "tool_use"]
    if not ids:
        return []
    if rng.random() < 0.5:
        ids = ids[::-1]
    out = [{"type": "tool_result", "tool_use_id": i, "content": f"result of {i}" * rng.choice([1, 3])} for i in ids]
    if rng.random() < 0.2:
        out.append({"type": "text", "text": "also, please hurry"})
    return out


def make_session(rng: random.Random, sid: str, n_turns: int, t0: int, retry_at: int | None = None,
                 branch_at: int | None = None, string_system: bool = False, string_body: bool = False,
                 model: str = "claude-sonnet") -> list[dict]:
    system = "You help." if string_system else [{"type": "text", "text": "You help.",
                                                   "cache_control": {"type": "ephemeral"}}]
    messages = [{"role": "user", "content": [{"type": "text", "text": f"task {sid}"}]}]
    calls, t = [], t0
    for turn in range(n_turns):
        resp = _resp(rng, sid, turn)
        body = {"system": system, "messages": copy.deepcopy(messages), "tools": TOOLS, "model": model,
                "max_tokens": 4096, "metadata": {"user_id": "u1"}}
        rec = {"session_id": sid, "biz_id": "b", "request_time": t,
               "request_body": json.dumps(body) if string_body and turn % 2 else body,
               "response_body": {"content": resp}}
        calls.append(rec)
        t += 1000
        if retry_at == turn:
            # the same context asked again; the conversation continues from the retry
            resp = _resp(rng, sid, turn, variant=1)
            calls.append({**copy.deepcopy(rec), "request_time": t, "response_body": {"content": resp}})
            t += 1000
        if branch_at == turn:
            # a side call on a shorter context (dropped unless extended)
            side = {"system": system, "messages": copy.deepcopy(messages[:1]), "tools": [], "model": model}
            calls.append({"session_id": sid, "request_time": t, "request_body": side,
                          "response_body": {"content": [{"type": "text", "text": "side"}]}})
            t += 1000
        messages.append({"role": "assistant", "content": _echo(resp)})
        res = _results(rng, resp)
        messages.append({"role": "user", "content": res or [{"type": "text", "text": f"continue {turn}"}]})
    return calls


def make_log(seed: int = 7, n_sessions: int = 12) -> list[str]:
    rng = random.Random(seed)
    lines = []
    for s in range(n_sessions):
        n = rng.randint(1, 6)
        lines += [json.dumps(c, ensure_ascii=False) for c in make_session(
            rng, f"s{s}", n, 1_000_000 * (s + 1),
            retry_at=rng.choice([None, None, rng.randrange(n)]),
            branch_at=rng.choice([None, rng.randrange(n)]),
            string_system=rng.random() < 0.3, string_body=rng.random() < 0.3,
            model=rng.choice(["claude-sonnet", "claude-sonnet", "claude-haiku"]))]
    lines += ["", "   ", "{not json", json.dumps({"session_id": None, "request_body": {}, "response_body": {}}),
              json.dumps({"session_id": "s_nobody", "request_time": 5})]
    rng.shuffle(lines)
    return lines


def canon(o):
    """JSON as a VARIANT prints it: sorted keys, no null fields, integral floats as ints."""
    match o:
        case dict():
            return {k: canon(o[k]) for k in sorted(o) if o[k] is not None}
        case list():
            return [canon(x) for x in o]
        case float() if o.is_integer():
            return int(o)
    return o


def write_log(dirpath: str, lines: list[str], n_files: int = 3) -> None:
    import os
    os.makedirs(dirpath, exist_ok=True)
    for f in range(n_files):
        part = lines[f::n_files]
        sub = os.path.join(dirpath, f"d{f % 2}")
        os.makedirs(sub, exist_ok=True)
        with open(os.path.join(sub, f"calls_{f}.jsonl"), "w", encoding="utf-8") as fh:
            fh.write("\n".join(part) + "\n")
