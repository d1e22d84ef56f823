"""Operators on tiny inline frames: one rule per test."""

import json

from pyspark.sql import functions as F

from relaytrace.operators.attribute import asof_attribute
from relaytrace.operators.cases import first_wins, has_trajectory, last_wins
from relaytrace.operators.dedup import prefix_dedup
from relaytrace.operators.filters import exclude_models
from relaytrace.operators.judge import call_judge, parse_verdicts
from relaytrace.operators.report import bucket_counts, distinct_sessions, funnel, scaffold_distribution
from relaytrace.operators.score import detailed_results, score_cases, score_summary
from relaytrace.functions.text import CONTENT_MARKER, REASONING_MARKER
from relaytrace.operators.select import indented_json, main_trajectory, truncate_message


def test_prefix_dedup_rules(spark):
    # session s: a, a+b (kept? extended by a+b+c), a+b+c, retry of a+b+c (later, kept), x (diverges, kept)
    calls = spark.createDataFrame([
        ("s", 1, ["a"]), ("s", 2, ["a", "b"]), ("s", 3, ["a", "b", "c"]), ("s", 4, ["a", "b", "c"]),
        ("s", 5, ["x"]), ("t", 1, []), ("t", 2, ["q"]), ("u", 1, [])],
        "session_id string, call_order long, ks array<string>")
    # keys are the prefixes themselves here (exact and prefix-stable)
    calls = calls.withColumn("pk", F.transform("ks", lambda x, i: F.array_join(F.slice("ks", 1, i + 1), "|")))
    calls = calls.withColumn("ctx_dkey", F.coalesce(F.try_element_at("pk", F.lit(-1)), F.lit("")))
    ctx = calls.select("session_id", "call_order", F.explode("pk").alias("dkey"))
    got = {(r.session_id, r.call_order) for r in prefix_dedup(ctx, calls).where("kept").collect()}
    assert got == {("s", 4), ("s", 5), ("t", 2), ("u", 1)}


def test_exclude_models_keeps_null(spark):
    df = spark.createDataFrame([("claude-Haiku",), ("sonnet",), (None,), ("",)], "model string")
    assert sorted(str(r.model) for r in exclude_models(df).collect()) == ["", "None", "sonnet"]


def test_main_trajectory_rules(spark):
    rows = spark.createDataFrame([
        ("k1", 1, True, 5), ("k1", 2, True, 7), ("k1", 3, True, 7), ("k1", 4, False, 9),
        ("k2", 1, False, 3), ("k2", 2, False, 1)], "key string, o long, ht boolean, n long")
    got = {r.key: r.o for r in main_trajectory(rows, "key", "o", "ht", "n", ["o"]).collect()}
    assert got == {"k1": 2, "k2": 2}


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, o long, v string")
    assert {r.id: r.v for r in last_wins(df, "id", ["o"]).collect()} == {"a": "y", "b": "z"}
    assert {r.id: r.v for r in first_wins(df, "id", ["o"]).collect()} == {"a": "x", "b": "z"}


def test_has_trajectory(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    traj = spark.createDataFrame([("a",), ("a",)], "sid string")
    got = {r.instance_id: r.has_trajectory for r in has_trajectory(cases, traj, "instance_id", "sid").collect()}
    assert got == {"a": True, "b": False}


def test_asof_attribute(spark):
    ann = spark.createDataFrame([("2024-01-01 00:10:00", "r1", 1), ("2024-01-01 05:00:00", "r2", 2)],
                                "ts string, instance_id string, eid long").withColumn("ts", F.col("ts").cast("timestamp"))
    calls = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00"), (3, "2024-01-01 04:59:59"),
                                   (4, "2024-01-01 05:00:00"), (5, "2024-01-03 00:00:00")], "id long, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.instance_id for r in asof_attribute(calls, ann, ann_tiebreak="eid").collect()}
    assert got == {1: "unknown", 2: "r1", 3: "r1", 4: "r2", 5: "r2"}


def _golden_checks(spark):
    # 5 categories, 32 checks, 30 successes (13/14, 3/3, 5/6, 4/4, 5/5)
    rows = []
    spec = [("style", 14, 1), ("limits", 3, 0), ("wish", 6, 1), ("house", 4, 0), ("calls", 5, 0)]
    types = ["tone"] * 26 + ["scope"] * 5 + ["form"]
    i = 0
    for cat, n, fails in spec:
        for j in range(n):
            rows.append(("case-1", cat, f"{cat}-{j}", types[i], "fail" if j < fails else "success"))
            i += 1
    # the failing form check and one tone failure
    return spark.createDataFrame(rows, "instance_id string, category string, check_id string, check_type string, result string")


def test_golden_score_shape(spark):
    checks = _golden_checks(spark)
    checks = checks.withColumn("result", F.when(F.col("check_type") == "form", "fail")
                               .when((F.col("category") == "wish") & (F.col("check_id") == "wish-0"), "success")
                               .otherwise(F.col("result")))
    status = spark.createDataFrame([("case-1", True, None)], "instance_id string, success boolean, error string")
    s = score_cases(status, checks).first()
    assert (s.total_checks, s.total_success, s.reward, s.binary_reward) == (32, 30, 0.938, 0)
    summ = score_summary(score_cases(status, checks)).first()
    assert (summ.total, summ.success_count, summ.avg_reward, summ.pass_count) == (1, 1, 0.938, 0)
    d = {(r.level, r.name): (r.success, r.fail) for r in detailed_results(checks).collect()}
    assert d[("total", None)] == (30, 2)
    assert d[("check_type", "form")] == (0, 1)


def test_parse_verdicts_statuses(spark):
    ok = json.dumps({"A": {"checks": [{"check_id": "1", "check_type": "t", "result": "success"},
                                      {"check_id": "2", "result": "SUCCESS"}]},
                     "B": {"description": "no checks"}})
    texts = [("ok", f"```json\n{ok}\n```"), ("bad", "not json {"), ("err", '{"error": "x", "A": 1}'),
             ("list", "[1, 2]"), ("listerr", '["error"]'), ("catnotobj", '{"A": 3}'),
             ("checksnull", '{"A": {"checks": null}}'), ("str", '"no"'), ("strerr", '"an error"'),
             ("emptychecks", '{"A": {"checks": ""}}')]
    df = spark.createDataFrame(texts, "instance_id string, response string")
    status, checks, cats = parse_verdicts(df)
    st = {r.instance_id: r.success for r in status.collect()}
    assert st == {"ok": True, "bad": True, "err": True, "list": False, "listerr": True, "catnotobj": False,
                  "checksnull": False, "str": False, "strerr": True, "emptychecks": True}
    scores = {r.instance_id: (r.reward_milli, r.total_checks) for r in score_cases(status, checks).collect()}
    assert scores["ok"] == (500, 2) and scores["bad"] == (0, 0) and scores["err"] == (0, 0)
    types = {(r.check_id, r.check_type) for r in checks.collect()}
    assert types == {("1", "t"), ("2", "unknown")}
    assert {(r.instance_id, r.category) for r in cats.collect()} >= {("ok", "A"), ("ok", "B")}


def test_call_judge_isolates_failures(spark):
    prompts = spark.createDataFrame([("a", "p1"), ("b", "p2")], "instance_id string, prompt string")

    def judge(ps):
        return [p.upper() for p in ps]

    def broken(ps):
        raise RuntimeError("down")
    got = {r.instance_id: r.response for r in call_judge(prompts, judge).collect()}
    assert got == {"a": "P1", "b": "P2"}
    errs = call_judge(prompts, broken).collect()
    assert all(r.response is None and "down" in r.judge_error for r in errs)


def test_reports(spark):
    df = spark.createDataFrame([("s1",), ("s1",), ("s2",), ("",)], "session_id string")
    assert distinct_sessions(df).first().n_sessions == 2
    assert sum(r.n_rows for r in bucket_counts(df).collect()) == 4
    f = {r.stage: r.n_rows for r in funnel([("in", df), ("out", df.where("session_id = 's1'"))]).collect()}
    assert f == {"in": 4, "out": 2}
    cases = spark.createDataFrame([("x",), (None,), ("claudecode",)], "name string")
    assert {r.scaffold: r.n_cases for r in scaffold_distribution(cases, F.col("name")).collect()} == \
        {"x": 1, "claudecode": 2}


def test_truncation_follows_the_kind_of_content(spark):
    def cut(role, content, **limits):
        df = spark.createDataFrame([(role, json.dumps(content), "r" * 12)], "role string, c string, reasoning_content string")
        m = F.struct("role", F.parse_json("c").alias("content"), "reasoning_content")
        row = df.select(truncate_message(m, 4, 6, 10).alias("m")).select(F.to_json("m.content").alias("c"), "m.reasoning_content").first()
        return json.loads(row.c), row.reasoning_content

    whole = "r" * 12
    assert cut("tool", "abcdef") == ("ab" + CONTENT_MARKER + "ef", whole)
    assert cut("tool", ["abcdef"]) == (["abcdef"], whole)
    assert cut("user", "abcdefgh") == ("abcdefgh", whole)
    blocks = [{"type": "text", "text": "abcdefgh", "n": 1}, {"type": "image", "text": "abcdefgh"}, {"type": "text", "text": 12345678}, "abcdefgh"]
    got, reasoning = cut("assistant", blocks)
    assert got == [{"type": "text", "text": "abc" + CONTENT_MARKER + "fgh", "n": 1}, *blocks[1:]]
    assert reasoning == "r" * 5 + REASONING_MARKER + "r" * 5


def test_indented_checklist_keeps_its_keys_in_order(spark):
    df = spark.createDataFrame([('{"z":{"checks":[1]},"a":"é"}',), (None,)], "t string")
    got = [r.t for r in df.select(indented_json("t").alias("t")).collect()]
    assert got == ['{\n  "z": {\n    "checks": [\n      1\n    ]\n  },\n  "a": "é"\n}', None]


def test_response_store_asks_only_for_new_prompts(spark, tmp_path):
    from relaytrace.operators.judge import call_judge, read_responses

    asked, store = tmp_path / "asked", str(tmp_path / "store")

    def judge(prompts):
        with open(asked, "a") as fh:
            fh.write("".join(p + "\n" for p in prompts))
        if "broken" in prompts[0]:
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    def run(rows, name):
        df = spark.createDataFrame(rows, "instance_id string, prompt string")
        return sorted((r.instance_id, r.response, r.judge_error) for r in call_judge(df, judge, store=store, run_id=name).collect())

    def calls():
        return sorted(asked.read_text().split()) if asked.exists() else []

    assert run([("a", "p1"), ("b", "p2"), ("c", "broken")], "1") == [("a", "P1", None), ("b", "P2", None), ("c", None, "RuntimeError: no answer")]
    assert calls() == ["broken", "p1", "p2"]
    # b's prompt changed, d is new, c had no answer; a is not asked again
    assert run([("a", "p1"), ("b", "p3"), ("c", "broken"), ("d", "p1")], "2") == [
        ("a", "P1", None), ("b", "P3", None), ("c", None, "RuntimeError: no answer"), ("d", "P1", None)]
    assert calls() == ["broken", "broken", "p1", "p1", "p2", "p3"]
    assert run([("a", "p1"), ("d", "p1")], "3") == [("a", "P1", None), ("d", "P1", None)] and len(calls()) == 6
    assert {(r.instance_id, r.response, r.run_id) for r in read_responses(spark, store).collect()} == {
        ("a", "P1", "1"), ("b", "P2", "1"), ("b", "P3", "2"), ("d", "P1", "2")}


def test_verdicts_keep_what_was_answered(spark):
    import json

    from relaytrace.operators.judge import verdicts

    rows = [("a", '```json\n{"x": {"checks": []}}\n```'), ("b", "no {json"), ("c", "")]
    got = {r.instance_id: json.loads(r.v) for r in verdicts(spark.createDataFrame(rows, "instance_id string, response string"))
           .select("instance_id", F.to_json("eval_result").alias("v")).collect()}
    assert got["a"] == {"x": {"checks": []}}
    assert got["b"] == {"error": "verdict is no JSON", "raw_response": "no {json"} and got["c"]["raw_response"] == ""


def test_exact_chunks(spark, tmp_path):
    import json
    import os

    from relaytrace.functions.keys import md5_bucket
    from relaytrace.plans.merge import write_chunks

    meta = F.struct(F.col("session_id"), F.lit("b").alias("biz_id"), F.lit("m").alias("model"), F.lit(1).cast("bigint").alias("max_tokens"), F.parse_json(F.lit("{}")).alias("extra"))

    def traj(n):
        return spark.range(n).repartition(5).select(
            F.concat(F.lit("s"), (F.col("id") % 6).cast("string")).alias("session_id"), F.struct(F.col("id").alias("request_time")).alias("call_order")).select(
            "*", meta.alias("meta"), F.array(F.lit("t")).alias("tools"), F.array(F.col("call_order.request_time")).alias("messages"))

    names = write_chunks(traj(25), f"{tmp_path}/out", chunk_size=10)
    assert names == ["trajectories_part001.jsonl", "trajectories_part002.jsonl", "trajectories_part003.jsonl"]
    assert sorted(x for x in os.listdir(f"{tmp_path}/out") if not x.startswith(".")) == names
    rows = [[json.loads(x) for x in open(f"{tmp_path}/out/{n}")] for n in names]
    assert [len(x) for x in rows] == [10, 10, 5]
    want = traj(25).select(md5_bucket(F.col("session_id"), 100).alias("b"), "session_id", F.col("messages")[0].alias("m")).orderBy("b", "session_id", "m").collect()
    assert [(r["meta"]["session_id"], r["messages"][0]) for part in rows for r in part] == [(r.session_id, r.m) for r in want]
    assert write_chunks(traj(10), f"{tmp_path}/one", chunk_size=10) == ["trajectories.jsonl"]
    assert write_chunks(traj(0), f"{tmp_path}/none") == ["trajectories.jsonl"] and os.path.getsize(f"{tmp_path}/none/trajectories.jsonl") == 0


def test_tool_results_by_position_and_by_id(spark):
    """Batch 1 was never answered: by position the later results are lost, by id none."""
    import json

    from relaytrace.plans.merge import merge_lines

    def use(*ids):
        return {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": f"n{i}", "input": {}} for i in ids]}

    def results(*ids):
        return {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": f"r{i}"} for i in ids]}

    messages = [{"role": "user", "content": "go"}, use("a", "b"), {"role": "user", "content": "no answer"}, use("c", "d"), results("d", "x", "c"), use("e"), results("e", "b")]
    line = json.dumps({"session_id": "s", "request_time": 1, "request_body": {"messages": messages}, "response_body": {"content": []}})
    df = spark.createDataFrame([(line, "f", 0, 0)], "value string, src_file string, src_block bigint, src_ord bigint")
    got = {}
    for match in ("position", "id"):
        row = merge_lines(df, match=match).trajectories.select(F.to_json("messages").alias("m"), "dropped_results").first()
        got[match] = [(m["tool_name"], m["content"]) for m in json.loads(row.m) if m["role"] == "tool"], row.dropped_results
    # the first results meet batch (a, b), the second batch (c, d)
    assert got["position"] == ([], 5)
    assert got["id"] == ([("nc", "rc"), ("nd", "rd"), ("x", "rx"), ("nb", "rb"), ("ne", "re")], 5)
