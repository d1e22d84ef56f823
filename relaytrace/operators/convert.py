"""Raw calls -> one nested conversation row.

All of it runs inside the row with higher-order functions over VARIANT
arrays: a kept call is one row, so conversion needs no shuffle.

* P10  tools -> ``{type:'function', function:{name, description,
  parameters:{type:'object', properties[, required]}}}``;
* P11  non-empty system -> leading system message (list content);
* P12/P13 user string passes; user block text is joined and emitted after
  that message's tool results, only when non-empty;
* P14/P16 assistant and final response: last text, last thinking, tool
  calls (absent when none);
* J3   ``tool_use_id -> name`` from every assistant tool use with non-empty
  id and name (last definition wins; unknown ids keep the id);
* J4   the k-th result-bearing user message follows the call order of the
  k-th tool-using assistant message (results missing from that batch are
  dropped); after the batches run out, results keep arrival order; for a
  repeated result id the last value sits at the first position.  With
  ``match='id'`` no result is dropped: a message's results follow the order in
  which their ids were last called, then come those of ids never called, as
  they arrived.  ``dropped_results`` counts, in either mode, the results that
  the positional pairing does not find in its batch;
* P5   any history assistant message with more than one thinking block
  drops the row (``multi_thinking``); P4 counts assistant messages
  including the final response (``few_turns``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------------
ROLE_SYSTEM, ROLE_USER, ROLE_ASSISTANT, ROLE_TOOL = "system", "user", "assistant", "tool"
BLOCK_TEXT, BLOCK_THINKING, BLOCK_TOOL_USE, BLOCK_TOOL_RESULT = "text", "thinking", "tool_use", "tool_result"
TOOL_TYPE = "function"
PARAMS_TYPE = "object"
META_KEYS = ("max_tokens", "session_id", "biz_id", "model")
DEFAULT_MIN_ASSISTANT_TURNS = 3
# ------------------------------------------------------------------------------------

MESSAGE_TYPE = ("struct<role:string,content:variant,tool_name:string,reasoning_content:string,"
                "generation:boolean,tool_calls:array<struct<name:string,arguments:variant>>>")


def kind(v: Column) -> Column:
    """JSON kind of a variant: OBJECT, ARRAY, STRING, VOID (null), numbers...; NULL if absent.

    Containers are recognised by a cast (O(1) on the top level); only
    scalars reach ``schema_of_variant``, which walks the whole value.
    """
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit("ARRAY"))
            .when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit("OBJECT"))
            .otherwise(F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)))


def vget(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, path, typ)


BLOCK_TYPE = "array<struct<t:string,v:variant,obj:boolean>>"


def _blocks(arr: Column) -> Column:
    """Decode a block list once: ``t`` = block type, ``v`` = block, ``obj`` = is an object."""
    return F.transform(arr, lambda b: F.struct(
        vget(b, "$.type", "string").alias("t"), b.alias("v"),
        F.try_variant_get(b, "$", "map<string,variant>").isNotNull().alias("obj")))


def _str_or(v: Column, path: str, default: str = "") -> Column:
    return F.coalesce(vget(v, path, "string"), F.lit(default))


def _as_variant_str(c: Column) -> Column:
    return c.cast("variant")


def _last_field(blocks: Column, btype: str, field: str) -> Column:
    picked = F.filter(blocks, lambda b: b["t"] == btype)
    return F.coalesce(_str_or(F.try_element_at(picked, F.lit(-1))["v"], f"$.{field}"), F.lit(""))


def _tool_calls(blocks: Column) -> Column:
    uses = F.filter(blocks, lambda b: b["t"] == BLOCK_TOOL_USE)
    calls = F.transform(uses, lambda b: F.struct(
        vget(b["v"], "$.name", "string").alias("name"),
        F.coalesce(vget(b["v"], "$.input"), F.parse_json(F.lit("{}"))).alias("arguments")))
    return F.when(F.size(calls) > 0, calls)


def convert_tools(tools: Column) -> Column:
    """P10 on an array<variant> of source-form tool definitions."""
    def one(t):
        schema = vget(t, "$.input_schema")
        return F.struct(
            F.lit(TOOL_TYPE).alias("type"),
            F.struct(_str_or(t, "$.name").alias("name"), _str_or(t, "$.description").alias("description"),
                     F.struct(F.lit(PARAMS_TYPE).alias("type"),
                              F.coalesce(vget(schema, "$.properties"), F.parse_json(F.lit("{}"))).alias("properties"),
                              vget(schema, "$.required", "array<string>").alias("required")).alias("parameters")
                     ).alias("function"))
    return F.transform(F.coalesce(tools, F.array().cast("array<variant>")), one)


def source_tools(tools: Column) -> Column:
    """Provider tool list (function-typed or already source form) -> source form."""
    def one(t):
        fn = vget(t, "$.function")
        is_fn = vget(t, "$.type", "string") == TOOL_TYPE
        return F.struct(
            F.when(is_fn, _str_or(fn, "$.name")).otherwise(_str_or(t, "$.name")).alias("name"),
            F.when(is_fn, _str_or(fn, "$.description")).otherwise(_str_or(t, "$.description")).alias("description"),
            F.coalesce(F.when(is_fn, vget(fn, "$.parameters")).otherwise(vget(t, "$.input_schema")),
                       F.parse_json(F.lit("{}"))).alias("input_schema"))
    return F.transform(F.coalesce(tools, F.array().cast("array<variant>")), one)


def normalize_system(system: Column) -> Column:
    """Null -> [], string -> one text block, list -> itself, other -> []."""
    k = kind(system)
    one_block = F.array(F.to_variant_object(F.struct(F.lit(BLOCK_TEXT).alias("type"),
                                                     vget(system, "$", "string").alias("text"))))
    return (F.when(k == "STRING", one_block)
            .when(k == "ARRAY", vget(system, "$", "array<variant>"))
            .otherwise(F.array().cast("array<variant>")))


def overlaid_meta(meta: Column) -> Column:
    """``meta`` as one variant object, the caller's metadata as its keys;
    where keys clash the call's own win."""
    own = F.create_map(*(x for k in META_KEYS for x in (F.lit(k), meta[k].cast("variant"))))
    given = F.coalesce(vget(meta["extra"], "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.to_variant_object(F.map_concat(F.map_filter(given, lambda k, _: ~k.isin(*META_KEYS)), own))


_STEPS_CACHE: dict = {}


def convert_all(calls: DataFrame, min_assistant_turns: int = DEFAULT_MIN_ASSISTANT_TURNS, match: str = "position") -> DataFrame:
    """Kept calls -> one converted row each, with ``reason`` set on rejects.
    ``match`` says how tool results meet their calls: by 'position' or by 'id'.

    Input columns: ``request``, ``response`` (variant), ``session_id``,
    ``biz_id``, ``model``, ``max_tokens``, ``gen_map``
    (map<int, struct<generation, sub>> by message index, ``sub`` = the
    replacement content or NULL), ``final_generation``.

    The column expressions only name input columns, so they are built once
    per SparkContext (thousands of driver-JVM calls) and reused.
    """
    if match not in ("position", "id"):
        raise ValueError(f"match is 'position' or 'id', not {match!r}")
    key = (id(calls.sparkSession.sparkContext), min_assistant_turns, match)
    if key not in _STEPS_CACHE:
        _STEPS_CACHE[key] = _conversion_steps(min_assistant_turns, match)
    steps, final = _STEPS_CACHE[key]
    df = calls
    for name, col in steps:
        df = df.withColumn(name, col)
    return df.select(*final)


def _conversion_steps(min_assistant_turns: int, match: str = "position"):
    steps: list = []
    req, resp = F.col("request"), F.col("response")
    msgs0 = F.coalesce(vget(req, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    msgs_null = kind(vget(req, "$.messages")) == "VOID"

    def shape(m, i):
        flag = F.element_at(F.col("gen_map"), i.cast("int"))
        content = F.coalesce(flag["sub"], vget(m, "$.content"))
        return F.struct(
            i.alias("idx"), vget(m, "$.role", "string").alias("role"), content.alias("content"),
            vget(content, "$", "array<variant>").alias("arr"),
            F.coalesce(flag["generation"], F.lit(False)).alias("generation"))

    def decode(m):
        ck = (F.when(m["content"].isNull(), F.lit(None).cast("string"))
              .when(m["arr"].isNotNull(), F.lit("ARRAY"))
              .when(F.try_variant_get(m["content"], "$", "map<string,variant>").isNotNull(), F.lit("OBJECT"))
              .otherwise(F.regexp_extract(F.schema_of_variant(m["content"]), r"^([A-Z]+)", 1)))
        blocks = F.coalesce(_blocks(m["arr"]), F.array().cast(BLOCK_TYPE))
        return F.struct(m["idx"].alias("idx"), m["role"].alias("role"), m["content"].alias("content"),
                        ck.alias("ck"), blocks.alias("blocks"), m["generation"].alias("generation"))

    steps += [("_m", F.transform(F.transform(msgs0, shape), decode)), ("_msgs_null", msgs_null)]

    def empty_ok(m):
        # iterating an empty string / empty object / missing content yields nothing
        return (m["ck"].isNull() | ((m["ck"] == "STRING") & (vget(m["content"], "$", "string") == ""))
                | ((m["ck"] == "OBJECT") & (F.size(vget(m["content"], "$", "map<string,variant>")) == 0)))

    def all_objects(m):
        return F.forall(m["blocks"], lambda b: b["obj"])

    asst = lambda m: m["role"] == ROLE_ASSISTANT
    user = lambda m: m["role"] == ROLE_USER
    md_kind = kind(vget(req, "$.metadata"))
    reason = (F.when(F.col("_msgs_null"), "bad_block")
              .when(md_kind.isNotNull() & (md_kind != "OBJECT"), "bad_block")
              .when(F.exists("_m", lambda m: asst(m) & (m["ck"] == "STRING") & ~empty_ok(m)), "assistant_string")
              .when(F.exists("_m", lambda m: asst(m) & ~empty_ok(m) & ~((m["ck"] == "ARRAY") & all_objects(m))),
                    "bad_block")
              .when(F.exists("_m", lambda m: user(m) & ~(m["ck"] == "STRING") & ~empty_ok(m)
                             & ~((m["ck"] == "ARRAY") & all_objects(m))), "bad_block")
              .when(F.exists("_m", lambda m: asst(m) & (F.size(F.filter(m["blocks"],
                                                                       lambda b: b["t"] == BLOCK_THINKING)) > 1)),
                    "multi_thinking"))
    steps.append(("_reason", reason))

    # Id -> name pairs from every assistant tool use (non-empty id and name)
    uses = F.transform(F.filter("_m", asst), lambda m: F.filter(F.transform(
        F.filter(m["blocks"], lambda b: b["t"] == BLOCK_TOOL_USE),
        lambda b: F.struct(_str_or(b["v"], "$.id").alias("id"), _str_or(b["v"], "$.name").alias("name"))),
        lambda u: (u["id"] != "") & (u["name"] != "")))
    steps.append(("_uses", uses))
    pairs = F.flatten(F.col("_uses"))
    # Call batches of tool-using assistant messages, in order
    batches = F.filter(F.transform("_uses", lambda a: F.transform(a, lambda u: u["id"])), lambda a: F.size(a) > 0)
    steps += [("_pairs", pairs), ("_batches", batches)]
    if match == "id":
        steps.append(("_called", F.transform("_pairs", lambda p: p["id"])))
    steps.append(("_results", F.transform("_m", lambda m: F.when(
        user(m) & (m["ck"] == "ARRAY"),
        F.transform(F.filter(m["blocks"], lambda b: b["t"] == BLOCK_TOOL_RESULT),
                    lambda b: F.struct(_str_or(b["v"], "$.tool_use_id").alias("id"),
                                       F.coalesce(vget(b["v"], "$.content"), _as_variant_str(F.lit("")))
                                       .alias("content"))))
        .otherwise(F.array().cast("array<struct<id:string,content:variant>>")))))
    steps.append(("_rb", F.transform("_results", lambda r: F.size(r) > 0)))

    def tool_name(id_: Column) -> Column:
        hit = F.try_element_at(F.filter("_pairs", lambda p: p["id"] == id_), F.lit(-1))
        return F.coalesce(hit["name"], id_)

    def tool_msg(id_: Column, results: Column) -> Column:
        last = F.try_element_at(F.filter(results, lambda r: r["id"] == id_), F.lit(-1))
        return F.struct(F.lit(ROLE_TOOL).alias("role"), last["content"].alias("content"),
                        tool_name(id_).alias("tool_name"), F.lit(None).cast("string").alias("reasoning_content"),
                        F.lit(None).cast("boolean").alias("generation"),
                        F.lit(None).cast("array<struct<name:string,arguments:variant>>").alias("tool_calls"))

    def text_msg(role: str, text: Column, gen: Column | None = None, reasoning: Column | None = None,
                 calls: Column | None = None) -> Column:
        return F.struct(F.lit(role).alias("role"), _as_variant_str(text).alias("content"),
                        F.lit(None).cast("string").alias("tool_name"),
                        (reasoning if reasoning is not None else F.lit(None).cast("string")).alias("reasoning_content"),
                        (gen if gen is not None else F.lit(None).cast("boolean")).alias("generation"),
                        (calls if calls is not None else
                         F.lit(None).cast("array<struct<name:string,arguments:variant>>")).alias("tool_calls"))

    # number of result-bearing messages before each message: a running count
    steps.append(("_k", F.transform("_rb", lambda x, i: F.when(x, F.size(F.filter(F.slice(F.col("_rb"), 1, i), lambda y: y))).otherwise(F.lit(0)))))

    def arrived(results: Column) -> Column:
        return F.array_distinct(F.transform(results, lambda r: r["id"]))

    def unpaired(m) -> Column:
        """Results that are not in the batch of their message's ordinal."""
        i = m["idx"]
        k = F.element_at(F.col("_k"), i + 1)
        batch = F.element_at(F.col("_batches"), k + 1)
        ids = arrived(F.element_at(F.col("_results"), i + 1))
        return F.when(F.element_at(F.col("_rb"), i + 1) & (k < F.size("_batches")), F.size(F.array_except(ids, batch))).otherwise(F.lit(0))

    def last_call(t: Column) -> Column:
        """Place of the last call of an id; NULL if there was none."""
        at = F.array_position(F.reverse("_called"), t)
        return F.when(at > 0, F.size("_called") - at)

    def out_for(m):
        i = m["idx"]
        results = F.element_at(F.col("_results"), i + 1)
        if match == "id":
            placed = F.transform(arrived(results), lambda t, j: F.struct(
                F.coalesce(last_call(t), F.size("_called") + j).cast("bigint").alias("at"), t.alias("id")))
            ids_in_order = F.transform(F.array_sort(placed), lambda x: x["id"])
        else:
            k = F.element_at(F.col("_k"), i + 1)
            ids_in_order = F.when(k < F.size("_batches"),
                                  F.filter(F.element_at(F.col("_batches"), k + 1),
                                           lambda t: F.exists(results, lambda r: r["id"] == t))) \
                .otherwise(arrived(results))
        tool_msgs = F.transform(ids_in_order, lambda t: tool_msg(t, results))
        utext = F.array_join(F.transform(F.filter(m["blocks"], lambda b: b["t"] == BLOCK_TEXT),
                                         lambda b: _str_or(b["v"], "$.text")), "")
        user_list = F.concat(tool_msgs, F.when(utext != "", F.array(text_msg(ROLE_USER, utext)))
                             .otherwise(F.array().cast(f"array<{MESSAGE_TYPE}>")))
        user_str = F.array(F.struct(F.lit(ROLE_USER).alias("role"), m["content"].alias("content"),
                                    F.lit(None).cast("string").alias("tool_name"),
                                    F.lit(None).cast("string").alias("reasoning_content"),
                                    F.lit(None).cast("boolean").alias("generation"),
                                    F.lit(None).cast("array<struct<name:string,arguments:variant>>").alias("tool_calls")))
        a_msg = F.array(text_msg(ROLE_ASSISTANT, _last_field(m["blocks"], BLOCK_TEXT, "text"), m["generation"],
                                 _last_field(m["blocks"], BLOCK_THINKING, "thinking"), _tool_calls(m["blocks"])))
        return (F.when(user(m) & (m["ck"] == "STRING"), user_str)
                .when(user(m) & (m["ck"] == "ARRAY"), user_list)
                .when(asst(m), a_msg)
                .otherwise(F.array().cast(f"array<{MESSAGE_TYPE}>")))

    system = normalize_system(vget(req, "$.system"))
    sys_msg = F.when(F.size(system) > 0, F.array(F.struct(
        F.lit(ROLE_SYSTEM).alias("role"), F.to_variant_object(system).alias("content"),
        F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("reasoning_content"),
        F.lit(None).cast("boolean").alias("generation"),
        F.lit(None).cast("array<struct<name:string,arguments:variant>>").alias("tool_calls")))) \
        .otherwise(F.array().cast(f"array<{MESSAGE_TYPE}>"))
    rblocks = F.coalesce(_blocks(vget(resp, "$.content", "array<variant>")), F.array().cast(BLOCK_TYPE))
    final = F.array(text_msg(ROLE_ASSISTANT, _last_field(rblocks, BLOCK_TEXT, "text"),
                             F.coalesce(F.col("final_generation"), F.lit(False)) & (F.size(rblocks) > 0),
                             _last_field(rblocks, BLOCK_THINKING, "thinking"), _tool_calls(rblocks)))
    messages = F.concat(sys_msg, F.flatten(F.transform("_m", out_for)), final)
    steps.append(("messages", messages))
    steps.append(("dropped_results", F.aggregate(F.transform("_m", unpaired), F.lit(0).cast("bigint"), lambda a, x: a + x)))
    steps.append(("n_assistant", F.size(F.filter("messages", lambda m: m["role"] == ROLE_ASSISTANT))))
    steps.append(("_reason", F.coalesce(F.col("_reason"), F.when(
        F.col("n_assistant") < min_assistant_turns, F.lit("few_turns")))))

    meta = F.struct(F.col("session_id"), F.col("biz_id"), F.col("model"), F.col("max_tokens"),
                    F.coalesce(vget(req, "$.metadata"), F.parse_json(F.lit("{}"))).alias("extra"))
    final = [meta.alias("meta"), convert_tools(vget(req, "$.tools", "array<variant>")).alias("tools"),
             "messages", "n_assistant", "session_id", "call_order", "dropped_results", F.col("_reason").alias("reason"),
             "src_file", "src_ord", F.when(F.col("_reason").isNotNull(), F.col("value")).alias("raw")]
    return steps, final


def split_converted(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trajectories, rejects) from ``convert_all`` output (best read from a written table)."""
    out = conv.where(F.col("reason").isNull()).select("meta", "tools", "messages", "n_assistant", "session_id",
                                                      "call_order", "dropped_results")
    rejects = conv.where(F.col("reason").isNotNull()).select(
        "src_file", "src_ord", F.lit("convert").alias("stage"), "reason", "raw")
    return out, rejects


def convert_rows(calls: DataFrame, min_assistant_turns: int = DEFAULT_MIN_ASSISTANT_TURNS) -> tuple[DataFrame, DataFrame]:
    """Kept calls -> (trajectories, rejects); see ``convert_all``."""
    return split_converted(convert_all(calls, min_assistant_turns))
