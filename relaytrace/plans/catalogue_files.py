"""More catalogue queries: files written and read back, rejects, provider
events, list content and run reports.  Registered in ``catalogue.QUERIES``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.convert import normalize_system
from ..operators.filters import only_case
from ..operators.ingest import DEFAULT_MAX_TOKENS, normalize_provider_events
from ..operators.report import distinct_sessions, run_results, run_success, write_runs
from ..operators.select import truncate_message
from ..functions.text import CONTENT_MARKER
from ..session import scratch_path
from ..sources.calls import encode_calls, parse_calls, read_cases, read_lines, read_trajectories
from ..sources.conversations import conversation_raw_log
from ..sources.tables import read_table
from ..streaming.jobs import attribute_streams, incremental_merge, read_attributed, read_merge_rejects, read_merged, stream_lines
from ..operators.judge import call_judge
from .catalogue import _CHECKLIST_SPARK, _EVENTS_SCHEMA, _JUDGE_SQL, _PIPE_SQL, _TOOL_ORDER_SQL, _TS_FMT, ORACLE_SQL, _trunc_sql, query, tool_batch_log
from .merge import materialize, merge_calls, merge_lines, write_chunks, write_trajectories
from .score import build_prompts, main_trajectories


# ---- P19: messages with string and list content ---------------------------------
# role of a document's message: by doc_id; assistants of even ids hold a list of a
# text and an image block, tools of even ids a list as well (left as it is)
_CUT = 300


@query("truncate_messages", f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'assistant' ELSE 'user' END AS role,
       md5(CASE WHEN doc_id % 3 = 1 OR (doc_id % 3 = 0 AND doc_id % 2 = 1)
           THEN {_trunc_sql('t', _CUT, CONTENT_MARKER)} ELSE t END) AS text_md5,
       md5({_trunc_sql('t', 2 * _CUT, CONTENT_MARKER.replace('content', 'reasoning'))}) AS reasoning_md5,
       CASE WHEN doc_id % 2 = 0 THEN t END AS image
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def truncate_messages(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    blocks = F.array(*(F.struct(F.lit(k).alias("type"), t.alias("text")) for k in ("text", "image")))
    even = F.col("doc_id") % 2 == 0
    role = F.element_at(F.array(*map(F.lit, ("tool", "assistant", "user"))), (F.col("doc_id") % 3 + 1).cast("int"))
    m = F.struct(role.alias("role"), F.when(even, F.to_variant_object(blocks)).otherwise(t.cast("variant")).alias("content"),
                 t.alias("reasoning_content"))
    # reasoning of every document is cut as an assistant's
    thought = F.struct(F.lit("assistant").alias("role"), t.cast("variant").alias("content"), t.alias("reasoning_content"))
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint"), truncate_message(m, _CUT, _CUT).alias("m"),
        truncate_message(thought, reasoning_limit=2 * _CUT)["reasoning_content"].alias("r"))
    at = F.try_variant_get("m.content", "$[0].text", "string")
    return docs.select("doc_id", "m.role", F.md5(F.coalesce(at, F.try_variant_get("m.content", "$", "string"))).alias("text_md5"),
                       F.md5("r").alias("reasoning_md5"), F.try_variant_get("m.content", "$[1].text", "string").alias("image"))


# ---- S5/S6: case files, the last line of an id wins -------------------------------
@query("case_files", """
SELECT 'case ' || CAST(item_id // 2 AS VARCHAR) AS instance_id, arg_max(text, item_id) AS system_prompt,
       CAST(max(item_id) AS BIGINT) AS item_id,
       '{"z":' || CAST(max(item_id) AS VARCHAR) || ',"a":{"checks":[]}}' AS checklist_text
FROM benchmark GROUP BY item_id // 2
""")
def case_files(spark, sf_dir):
    items = read_table(spark, sf_dir, "benchmark")
    out = scratch_path(spark, "cases")
    checklist = F.struct(F.col("item_id").alias("z"), F.struct(F.array().cast("array<int>").alias("checks")).alias("a"))
    (items.orderBy("item_id").select(F.concat(F.lit("case "), F.floor(F.col("item_id") / 2).cast("string")).alias("instance_id"),
                                     F.col("text").alias("system_prompt"), checklist.alias("checklist"))
     .write.json(out))
    return read_cases(spark, out).select("instance_id", "system_prompt", F.try_variant_get("checklist", "$.z", "bigint").alias("item_id"),
                                         "checklist_text")


# ---- S1, S4: calls encoded, written, read and parsed again -------------------------
@query("call_files", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS n_messages, md5(text) AS response_md5
FROM conversations WHERE role = 'assistant'
""")
def call_files(spark, sf_dir):
    calls, _ = parse_calls(conversation_raw_log(read_table(spark, sf_dir, "conversations")))
    out = scratch_path(spark, "encoded")
    encode_calls(calls).write.text(f"{out}/day=1")
    again, _ = parse_calls(read_lines(spark, out))
    system = normalize_system(F.try_variant_get("request", "$.system", "variant"))
    n = F.size(F.try_variant_get("request", "$.messages", "array<variant>")) + F.size(system)
    return again.select("session_id", n.cast("bigint").alias("n_messages"),
                        F.md5(F.try_variant_get("response", "$.content[0].text", "string")).alias("response_md5"))


# ---- S1, S7, S9, W2: merged files read back; one trajectory a session ---------------
@query("trajectory_files", f"""
SELECT session_id, n_messages, n_assistant FROM ({_PIPE_SQL})
""")
def trajectory_files(spark, sf_dir):
    raw, out = scratch_path(spark, "raw-calls"), scratch_path(spark, "trajectories")
    conversation_raw_log(read_table(spark, sf_dir, "conversations")).select("value").write.text(raw)
    write_trajectories(merge_calls(spark, raw).trajectories, out, chunk_size=50)
    main = main_trajectories(read_trajectories(spark, out))
    return main.select("session_id", F.size("messages").cast("bigint").alias("n_messages"),
                       F.size(F.filter("messages", lambda m: m["role"] == "assistant")).cast("bigint").alias("n_assistant"))


# ---- S2, S3, P1, P5 and the reject reasons -----------------------------------------
# one call per event; what is wrong with it follows from event_id % 10
_TURN = '{"role":"user","content":"go"},{"role":"assistant","content":[{"type":"text","text":"on"}]}'
_ODD = {4: '{"role":"assistant","content":"plain"}',
        5: '{"role":"assistant","content":[{"type":"thinking","thinking":"a"},{"type":"thinking","thinking":"b"}]}',
        7: "1", 9: '{"role":"assistant","content":["x"]}'}


_REASONS_SQL = """
SELECT stage, reason, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT CASE event_id % 10 WHEN 2 THEN 'parse' WHEN 3 THEN 'parse' WHEN 7 THEN 'context' WHEN 0 THEN 'merged'
                            WHEN 1 THEN 'merged' ELSE 'convert' END AS stage,
         CASE event_id % 10 WHEN 2 THEN 'bad_json' WHEN 3 THEN 'bad_body' WHEN 4 THEN 'assistant_string'
              WHEN 5 THEN 'multi_thinking' WHEN 6 THEN 'few_turns' WHEN 7 THEN 'bad_context: element is not an object'
              WHEN 9 THEN 'bad_block' ELSE '' END AS reason
  FROM events WHERE event_id % 10 <> 8) GROUP BY 1, 2
"""


def _odd_calls(spark, sf_dir):
    n, i = F.col("event_id") % 10, F.col("event_id").cast("string")
    odd = F.lit("")
    for k, message in _ODD.items():
        odd = F.when(n == k, F.lit("," + message)).otherwise(odd)
    turns = F.when(n == 6, F.lit('{"role":"user","content":"go"}')).otherwise(F.lit(f"{_TURN},{_TURN}"))
    request = F.concat(F.lit('{"model":"'), F.when(n == 8, "a-Haiku-b").otherwise("m"), F.lit('","messages":['), turns, odd, F.lit("]}"))
    response = F.lit('{"content":[{"type":"text","text":"done"}]}')
    quoted = lambda c: F.when(n == 1, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)
    value = F.concat(F.lit('{"session_id":"s'), i, F.lit('","request_time":'), i, F.lit(',"request_body":'), quoted(request),
                     F.when(n == 3, "").otherwise(F.concat(F.lit(',"response_body":'), quoted(response))), F.when(n == 2, "").otherwise("}"))
    return read_table(spark, sf_dir, "events").select("event_id", value.alias("value"))


def _reasons(trajectories, rejects):
    done = trajectories.select(F.lit("merged").alias("stage"), F.lit("").alias("reason"))
    return rejects.select("stage", "reason").unionByName(done).groupBy("stage", "reason").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("reject_reasons", _REASONS_SQL)
def reject_reasons(spark, sf_dir):
    """Every reject reason; calls of excluded models (8) leave no row."""
    out = scratch_path(spark, "odd-calls")
    _odd_calls(spark, sf_dir).select("value").write.text(out)
    res = merge_calls(spark, out)
    return _reasons(res.trajectories, res.rejects)


@query("stream_rejects", _REASONS_SQL)
def stream_rejects(spark, sf_dir):
    """X2 with rejects: the same lines arrive in two batches; rows and rejects of
    an epoch are committed together."""
    src, state, out, ck = (scratch_path(spark, f"odd-{x}") for x in ("in", "state", "out", "ck"))
    lines = _odd_calls(spark, sf_dir)
    for name, part in (("a", F.col("event_id") % 3 != 1), ("b", F.col("event_id") % 3 == 1)):
        lines.where(part).select("value").write.text(f"{src}/{name}")
        incremental_merge(spark, stream_lines(spark, f"{src}/*"), state, out, ck).awaitTermination()
    return _reasons(read_merged(spark, out), read_merge_rejects(spark, out))


# ---- P2, P6-P9, P24, E1: provider events to raw calls ---------------------------------
@query("provider_events", f"""
WITH c AS (SELECT event_id, ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
           WHERE event_type NOT IN ('error', 'signup') AND event_id % 5 <> 4)
SELECT c.event_id, coalesce(CAST(a.user_id AS VARCHAR), 'unknown') AS session_id, epoch_us(c.ts) // 1000 AS request_time,
       CASE WHEN k % 2 = 0 THEN k + 1 ELSE {DEFAULT_MAX_TOKENS} END AS max_tokens,
       (CASE WHEN k % 3 = 0 THEN 'thinking,' ELSE '' END) || (CASE WHEN event_type = 'view' THEN '' ELSE 'text,' END) || 'tool_use' AS block_types,
       k AS input_k, CASE WHEN event_type = 'view' THEN 'q' || CAST(k AS VARCHAR) END AS raw_input
FROM c ASOF LEFT JOIN (SELECT ts, user_id FROM events WHERE event_type = 'signup') a ON c.ts >= a.ts
""".replace("k AS input_k", "CASE WHEN event_type <> 'view' THEN k END AS input_k"))
def provider_events(spark, sf_dir):
    """Calls of an excluded model (every fifth) and failed ones are not logged;
    views call their tool with text that is no JSON."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    view, kn = F.col("event_type") == "view", k.cast("bigint")
    message = F.concat(
        F.lit('{"content":"'), F.when(view, "").otherwise("said"), F.lit('","thinking_blocks":['),
        F.when(kn % 3 == 0, '{"type":"thinking","thinking":"hm"}').otherwise(""),
        F.lit('],"tool_calls":[{"id":"t1","function":{"name":"look","arguments":"'),
        F.when(view, F.concat(F.lit("q"), k)).otherwise(F.concat(F.lit('{\\"k\\":'), k, F.lit("}"))), F.lit('"}}]}'))
    calls = ev.where("event_type <> 'signup'").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_id") % 5 == 4, "some-haiku").otherwise("m").alias("model"), F.lit(None).cast("bigint").alias("max_tokens"),
        F.parse_json(F.concat(F.lit('{"max_tokens":'), F.when(kn % 2 == 0, (kn + 1).cast("string")).otherwise("0"), F.lit("}"))).alias("optional_params"),
        F.parse_json(F.lit("null")).alias("system"), F.parse_json(F.lit("[]")).alias("messages"), F.parse_json(F.lit("[]")).alias("tools"),
        F.parse_json(F.concat(F.lit('[{"message":'), message, F.lit("}]"))).alias("choices"))
    ann = ev.where("event_type = 'signup'").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("instance_id"))
    raw = normalize_provider_events(calls, ann, extra_cols={"event_id": F.col("event_id")})
    used = F.try_variant_get(F.parse_json("value"), "$.response_body.content", "array<variant>")[F.size("content_types") - 1]
    return raw.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), "session_id", "request_time",
                      F.get_json_object("value", "$.request_body.max_tokens").cast("bigint").alias("max_tokens"),
                      F.array_join("content_types", ",").alias("block_types"), F.try_variant_get(used, "$.input.k", "bigint").alias("input_k"),
                      F.try_variant_get(used, "$.input.raw", "string").alias("raw_input"))


# ---- P3, P23, S12, A10, A12: runs -----------------------------------------------------
@query("run_files", """
SELECT CAST(d.doc_id AS VARCHAR) AS instance_id, CASE WHEN d.doc_id % 3 = 0 THEN 'claudecode' ELSE d.lang END AS scaffold,
       'm1' AS model, coalesce(l.quality = 1, false) AS success
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def run_files(spark, sf_dir):
    cases = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("instance_id"), F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("name")).alias("scaffold"))
    outcomes = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("instance_id"), (F.col("quality") == 1).alias("success"))
    out = scratch_path(spark, "runs")
    write_runs(run_results(cases, outcomes, "m1"), out)
    return spark.read.schema("instance_id string, scaffold string, model string, success boolean").json(out)


@query("run_success", "SELECT CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS success_count, CAST(count(*) AS BIGINT) AS total FROM labels")
def run_success_q(spark, sf_dir):
    return run_success(read_table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("success")))


@query("distinct_sessions", "SELECT CAST(count(DISTINCT conv_id) AS BIGINT) AS n_sessions FROM conversations")
def distinct_sessions_q(spark, sf_dir):
    return distinct_sessions(read_table(spark, sf_dir, "conversations"), "conv_id")


@query("single_case", """
SELECT event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events WHERE event_type = 'error')
""")
def single_case(spark, sf_dir):
    """The runs of one named case: the first user with an error."""
    ev = read_table(spark, sf_dir, "events").withColumn("instance_id", F.col("user_id").cast("string"))
    first = ev.where("event_type = 'error'").agg(F.min("user_id")).first()[0]
    return only_case(ev, None if first is None else str(first)).select(F.col("event_id").cast("bigint"), "event_type")


# ---- X3: both sides arrive as streams, announcements late --------------------------
@query("late_announcements", ORACLE_SQL["stream_attribution"])
def late_announcements(spark, sf_dir):
    """Every third run is announced only after all calls have been attributed."""
    ev = read_table(spark, sf_dir, "events")
    is_call = F.col("event_type") != "signup"
    late = F.col("user_id") % 3 == 0
    src, out, ck = (scratch_path(spark, f"late-{x}") for x in ("in", "out", "ck"))
    arrivals = [is_call & (F.col("event_id") % 2 == 0) | ~is_call & (F.col("user_id") % 3 == 1),
                is_call & (F.col("event_id") % 2 == 1) | ~is_call & (F.col("user_id") % 3 == 2), ~is_call & late]
    stream = spark.readStream.schema(_EVENTS_SCHEMA).option("timestampNTZFormat", _TS_FMT).json(f"{src}/*")
    calls = stream.where(is_call).select("event_id", "ts")
    runs = stream.where(~is_call).select("ts", F.col("user_id").alias("instance_id"), F.col("event_id").alias("announced"))
    for i, some in enumerate(arrivals):
        ev.where(some).write.option("timestampNTZFormat", _TS_FMT).json(f"{src}/{i}")
        attribute_streams(calls, runs, out, ck, ["event_id"], ann_tiebreak="announced").awaitTermination()
    return read_attributed(spark, out, ["event_id"]).select(F.col("event_id").cast("bigint"), "instance_id")


# ---- J4 by id, and what the positional pairing loses --------------------------------
_BY_ID_SQL = _TOOL_ORDER_SQL[:_TOOL_ORDER_SQL.index("emit AS (")] + """
called AS (SELECT sid, tid, max(msg * 10 + pos) AS last FROM uses GROUP BY sid, tid),
lost AS (SELECT p.sid, count(*) AS n FROM paired p JOIN dict d ON d.sid = p.sid AND d.msg = p.msg
         WHERE p.amsg IS NOT NULL AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.sid = p.sid AND u.msg = p.amsg AND u.tid = d.tid)
         GROUP BY p.sid)
SELECT d.sid AS session_id, CAST(count(*) AS BIGINT) AS n_tool_msgs,
       string_agg(coalesce(n.name, d.tid) || ':' || d.content, ',' ORDER BY d.msg, coalesce(c.last, 1000 + d.fpos)) AS tool_seq,
       CAST(coalesce(max(l.n), 0) AS BIGINT) AS n_dropped
FROM dict d LEFT JOIN names n ON n.sid = d.sid AND n.tid = d.tid
  LEFT JOIN called c ON c.sid = d.sid AND c.tid = d.tid LEFT JOIN lost l ON l.sid = d.sid GROUP BY d.sid
"""


@query("tool_results_by_id", _BY_ID_SQL)
def tool_results_by_id(spark, sf_dir):
    """Results matched by id: none is lost; ``n_dropped`` counts those that the
    positional pairing of the same rows would lose."""
    traj = merge_lines(tool_batch_log(read_table(spark, sf_dir, "events")), match="id").trajectories
    tools = traj.select("session_id", "dropped_results", F.filter("messages", lambda m: m["role"] == "tool").alias("t"))
    seq = F.transform("t", lambda m: F.concat(m["tool_name"], F.lit(":"), F.try_variant_get(m["content"], "$", "string")))
    return tools.where(F.size("t") > 0).select("session_id", F.size("t").cast("bigint").alias("n_tool_msgs"),
                                               F.array_join(seq, ",").alias("tool_seq"), F.col("dropped_results").alias("n_dropped"))


# ---- S9, W6, W7: files of exactly so many rows, in output order ------------------------
_CHUNK = 20


@query("chunk_files", f"""
WITH t AS ({_PIPE_SQL}),
o AS (SELECT session_id, row_number() OVER (ORDER BY CAST(('0x' || md5(session_id))::UHUGEINT % 100 AS INTEGER), session_id) - 1 AS i FROM t),
c AS (SELECT session_id, i, i // {_CHUNK} AS k, (SELECT count(*) FROM o) > {_CHUNK} AS many FROM o)
SELECT CASE WHEN many THEN 'trajectories_part' || lpad(CAST(k + 1 AS VARCHAR), CAST(greatest(3, len(CAST(k + 1 AS VARCHAR))) AS INTEGER), '0') || '.jsonl' ELSE 'trajectories.jsonl' END AS file_name,
       CAST(count(*) AS BIGINT) AS n_rows, arg_min(session_id, i) AS first_session, arg_max(session_id, i) AS last_session,
       md5(string_agg(session_id, ',' ORDER BY i)) AS sessions_md5
FROM c GROUP BY 1
""")
def chunk_files(spark, sf_dir):
    out = scratch_path(spark, "chunk-files")
    write_chunks(merge_lines(conversation_raw_log(read_table(spark, sf_dir, "conversations"))).trajectories, out, chunk_size=_CHUNK)
    rows = spark.read.text(out).select(F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("i"),
                                       F.get_json_object("value", "$.meta.session_id").alias("s"))
    per = rows.groupBy("file_name").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.min_by("s", "i").alias("first_session"),
                                        F.max_by("s", "i").alias("last_session"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("a"))
    return per.select("file_name", "n_rows", "first_session", "last_session",
                      F.md5(F.array_join(F.transform("a", lambda x: x["s"]), ",")).alias("sessions_md5"))


# ---- W2 in the scope of a file -------------------------------------------------------
@query("file_scope", """
WITH c AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, n, conv_id % 7 AS file, 's' || CAST(conv_id // 3 AS VARCHAR) AS session, conv_id % 3 = 0 AND conv_id % 7 <> 5 AS tools FROM c),
best AS (SELECT file, conv_id, n FROM r QUALIFY row_number() OVER (PARTITION BY file
           ORDER BY tools DESC, CASE WHEN tools THEN n ELSE 0 END DESC, CASE WHEN tools THEN conv_id ELSE -conv_id END) = 1),
f AS (SELECT session, arg_min(file, conv_id) AS file FROM r GROUP BY session)
SELECT f.session AS session_id, CAST(best.conv_id AS BIGINT) AS main_conv, CAST(best.n AS BIGINT) AS n_messages FROM f JOIN best ON best.file = f.file
""")
def file_scope(spark, sf_dir):
    """Every session scored on the main row of the file it first occurs in."""
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    with_tools = (F.col("conv_id") % 3 == 0) & (F.col("conv_id") % 7 != 5)
    rows = c.select(F.concat(F.lit("s"), F.floor(F.col("conv_id") / 3).cast("string")).alias("session_id"),
                    (F.col("conv_id") % 7).alias("src_file"), F.col("conv_id").alias("file_order"),
                    F.when(with_tools, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("tools"),
                    F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda _: F.col("conv_id")).alias("messages"))
    main = main_trajectories(rows, scope="file")
    return main.select("session_id", F.element_at("messages", 1).cast("bigint").alias("main_conv"), F.size("messages").cast("bigint").alias("n_messages"))


# ---- E2: answers are kept, a second run asks only for what is new ----------------------
@query("judge_store", _JUDGE_SQL + """
SELECT CAST(item_id AS VARCHAR) AS instance_id, CASE WHEN item_id % 2 = 0 THEN 'first' ELSE 'second' END AS run_id, na AS n_turns
FROM m WHERE NOT no_checklist
""")
def judge_store(spark, sf_dir):
    """The first run judges the even cases, the second all: each answer is of the
    run that asked for it, and no prompt was asked for twice."""
    traj = materialize(merge_lines(conversation_raw_log(read_table(spark, sf_dir, "conversations"))).trajectories, "judge-store-traj")
    main = main_trajectories(traj, "call_order")
    cases = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("instance_id"), F.expr(_CHECKLIST_SPARK).alias("checklist"))
    store = scratch_path(spark, "responses")
    prompts, _, _ = build_prompts(cases, main)
    for run, some in (("first", prompts.where(F.col("instance_id").cast("bigint") % 2 == 0)), ("second", prompts)):
        call_judge(some, count_turns, store=store, run_id=run)
    kept = spark.read.parquet(store)  # every answer ever added
    return kept.select("instance_id", "run_id", F.col("response").cast("bigint").alias("n_turns"))


def count_turns(prompts: list[str]) -> list[str]:
    """A judge that answers with the number of assistant turns it was shown."""
    return [str(p.count('"assistant_turn_index":')) for p in prompts]
