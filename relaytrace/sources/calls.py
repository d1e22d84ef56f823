"""Tolerant JSONL scans of raw calls, cases and trajectories.

Raw call lines are parsed once into ``VARIANT`` (bodies may be objects or
JSON strings); scalars are typed, payloads stay variant.  Bad lines are not
dropped silently: they go to a ``rejects`` frame with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import cut_context_hashes
from ..operators.filters import DEFAULT_EXCLUDED_MODELS, model_allowed
from ..session import ship_package


def _kind(v: Column) -> Column:
    """Top-level kind of a scalar variant: STRING, BIGINT, DECIMAL, ... (NULL if missing).

    Only for small values: ``schema_of_variant`` walks the whole value.
    """
    return F.when(v.isNotNull(), F.substring_index(F.schema_of_variant(v), "(", 1))


def _is_object(v: Column, likely: str) -> Column:
    """Top-level object test: only an object has the field ``likely``; where that is
    missing a cast tells (it copies every field, but does not walk nested values)."""
    return F.try_variant_get(v, f"$.{likely}", "variant").isNotNull() | F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _once(text: Column, word: str) -> Column:
    """Whether ``word`` stands at most once in ``text`` (cheaper than a pattern)."""
    return F.substring_index(text, word, 2) == text


def _body(v: Column) -> Column:
    """A body given as an object, or as a JSON string holding one.

    Objects and arrays do not cast to a string, so only string (and scalar)
    bodies are re-parsed; anything that is not an object is rejected later.
    """
    return F.coalesce(F.try_parse_json(F.try_variant_get(v, "$", "string")), v)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` (recursive), non-blank lines, with source order."""
    raw = (spark.read.option("recursiveFileLookup", "true").text(path)
           .select("value", F.col("_metadata.file_path").alias("src_file"),
                   F.col("_metadata.file_block_start").alias("src_block"),
                   F.monotonically_increasing_id().alias("src_ord")))
    return raw.where(F.col("value").rlike(r"(?U)\S"))


def parse_all(lines: DataFrame, excluded_models=DEFAULT_EXCLUDED_MODELS, model_path: str = "any") -> DataFrame:
    """S2 + S3 + P1 for every line: typed call columns plus ``reason`` (NULL if
    the line is a good call) and ``excluded`` (model filter).  No filtering
    happens here: filtering a computed column lets the optimizer copy the
    whole parse into the predicate, so callers split after writing once.
    """
    v = F.try_parse_json(F.col("value"))
    df = lines.withColumn("_v", v)
    sid_v = F.try_variant_get(F.col("_v"), "$.session_id", "variant")
    meta_v = F.try_variant_get(F.col("_v"), "$.meta", "variant")
    meta_model_v = F.try_variant_get(meta_v, "$.model", "variant")
    req = _body(F.try_variant_get(F.col("_v"), "$.request_body", "variant"))
    resp = _body(F.try_variant_get(F.col("_v"), "$.response_body", "variant"))
    rt_v = F.try_variant_get(F.col("_v"), "$.request_time", "variant")
    df = (df.withColumn("_req", req).withColumn("_resp", resp)
          .withColumn("_sid_kind", _kind(sid_v)).withColumn("_meta_obj", _is_object(meta_v, "model"))
          .withColumn("_mm_kind", _kind(meta_model_v)).withColumn("_rt_kind", _kind(rt_v)))
    # a valid JSON text is an object iff its first non-blank character is '{'
    row_is_object = F.startswith(F.col("value"), F.lit("{")) | (F.regexp_extract(F.col("value"), r"^\s*(\S)", 1) == "{")
    reason = (F.when(F.col("_v").isNull(), "bad_json")
              .when(~row_is_object, "bad_json")
              .when(F.col("_sid_kind").isNotNull() & (F.col("_sid_kind") != "STRING"), "bad_json")
              .when(meta_v.isNotNull() & ~F.col("_meta_obj"), "bad_json")
              .when(F.col("_mm_kind").isNotNull() & (F.col("_mm_kind") != "STRING"), "bad_json")
              .when(F.col("_rt_kind").isNotNull() & ~F.col("_rt_kind").isin("BIGINT", "INT", "SMALLINT", "TINYINT",
                                                                          "DECIMAL"), "bad_json")
              .when(F.col("_req").isNull() | ~_is_object(F.col("_req"), "model"), "bad_body")
              .when(F.col("_resp").isNull() | ~_is_object(F.col("_resp"), "content"), "bad_body"))
    meta_model = F.try_variant_get(meta_v, "$.model", "string")
    req_model = F.try_variant_get(F.col("_req"), "$.model", "string")
    model_for_filter = meta_model if model_path == "meta" else F.coalesce(meta_model, req_model)
    out = df.select(
        F.coalesce(F.try_variant_get(F.col("_v"), "$.session_id", "string"), F.lit("")).alias("session_id"),
        F.coalesce(F.try_variant_get(F.col("_v"), "$.biz_id", "string"), F.lit("")).alias("biz_id"),
        F.coalesce(F.try_variant_get(F.col("_v"), "$.request_time", "bigint"), F.lit(0)).alias("request_time"),
        F.coalesce(req_model, F.lit("")).alias("model"),
        F.coalesce(F.try_variant_get(F.col("_req"), "$.max_tokens", "bigint"), F.lit(0)).alias("max_tokens"),
        F.col("_req").alias("request"), F.col("_resp").alias("response"),
        "value", "src_file", "src_block", "src_ord", reason.alias("reason"), (~model_allowed(model_for_filter, excluded_models)).alias("_not_allowed"))
    out = out.withColumn("excluded", F.col("reason").isNull() & F.col("_not_allowed")).drop("_not_allowed")
    return out.withColumn("call_order", F.struct("request_time", "src_file", "src_block", "src_ord"))


def split_parsed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, rejects) from ``parse_all`` output (best read from a written table)."""
    rejects = df.where(F.col("reason").isNotNull()).select(
        "src_file", "src_ord", F.lit("parse").alias("stage"), "reason", F.col("value").alias("raw"))
    calls = df.where(F.col("reason").isNull() & ~F.col("excluded")).drop("reason", "excluded")
    return calls, rejects


def parse_calls(lines: DataFrame, excluded_models=DEFAULT_EXCLUDED_MODELS,
                model_path: str = "any") -> tuple[DataFrame, DataFrame]:
    """S2 + S3 + P1: raw lines -> (calls, rejects).

    ``model_path='meta'`` excludes by ``meta.model`` only; the default also
    reads ``request_body.model`` (the logger's own field).
    """
    return split_parsed(parse_all(lines, excluded_models, model_path))


def _cut_bodies(line: Column) -> Column:
    """Texts of a line's two bodies in one reading."""
    return F.from_json(line, "request_body string, response_body string")


def _cut_request(body: Column) -> Column:
    """Texts of a request's system and messages in one reading."""
    return F.from_json(body, "system string, messages array<string>")


def _element_texts(line: Column, request: Column, response: Column, bodies: Column | None = None,
                   asked: Column | None = None) -> tuple[Column, Column, Column]:
    """JSON texts of a call's system blocks, messages and response content, cut
    out of the line as they stand there; NULL where that is not safe.

    ``bodies`` and ``asked`` are ``_cut_bodies`` of the line and ``_cut_request`` of
    its request, as columns that were computed before: each expression here names
    them several times."""
    bodies = _cut_bodies(line) if bodies is None else bodies
    asked = _cut_request(bodies["request_body"]) if asked is None else asked
    empty = F.array().cast("array<string>")

    def texts(v: Column, cut: Column, field: str) -> Column:
        # as many objects as there are elements: each element is one
        objects = F.filter(F.try_variant_get(v, "$", f"array<struct<{field}:string>>"), lambda x: x.isNotNull())
        whole = (F.size(objects) == F.size(cut)) & ~F.exists(cut, lambda x: x.isNull())
        return F.when(v.isNull() | F.is_variant_null(v), empty).when(whole, cut)

    answered = bodies["response_body"]
    system = F.try_variant_get(request, "$.system", "variant")
    said = F.try_variant_get(system, "$", "string")
    one = F.when(said.isNotNull() & (_kind(system) == "STRING"), F.array(F.to_json(F.struct(F.lit("text").alias("type"), said.alias("text")))))
    content = F.try_variant_get(response, "$.content", "variant")
    completion = F.when(content.isNull() | F.is_variant_null(content), F.lit("[]")).when(
        F.try_variant_get(content, "$", "array<variant>").isNotNull(), F.get_json_object(answered, "$.content"))
    # one key of that name is the one that Spark took; of several the values are compared
    alone = _once(answered, "content") & ~F.contains(answered, F.lit("\\u"))
    same = alone | (F.to_json(F.try_parse_json(completion)) == F.to_json(content))
    completion = F.when(content.isNull() | F.is_variant_null(content) | same, completion)
    # surrogates that are escaped may have no text of their own in Spark; of keys that
    # stand twice Spark takes one or the other and Python the last
    safe = ~(F.contains(line, F.lit("\\u")) & line.rlike(r"\\u[dD][89abAB]"))
    for k in ("request_body", "response_body", "messages", "system"):
        safe = safe & (_once(line, k) | (F.regexp_count("value", F.lit(rf'"{k}\\*"\s*:')) <= 1))
    messages = F.try_variant_get(request, "$.messages", "variant")
    blocks = F.from_json(asked["system"], "array<string>")
    return tuple(F.when(safe, c) for c in (F.coalesce(texts(system, blocks, "type"), one), texts(messages, asked["messages"], "role"), completion))


def canonicalise_all(parsed: DataFrame) -> DataFrame:
    """E4 on every parsed row; adds the context hash columns and ``ctx_reason``."""
    ship_package(parsed.sparkSession)
    # lines that are no calls need no hashes; of the calls some cannot be cut and are
    # decoded (and reported) as they are
    live = F.col("reason").isNull()
    cuts = parsed.withColumn("_bodies", _cut_bodies(F.col("value")))
    cuts = cuts.withColumn("_asked", _cut_request(F.col("_bodies")["request_body"]))
    system, messages, completion = _element_texts(F.col("value"), F.col("request"), F.col("response"), F.col("_bodies"), F.col("_asked"))
    c = cuts.withColumn("_system", system).withColumn("_messages", messages).withColumn("_completion", completion)
    cut = live & F.col("_system").isNotNull() & F.col("_messages").isNotNull() & F.col("_completion").isNotNull()
    c = c.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    c = c.withColumn("_ctx", cut_context_hashes(
        F.when(live & ~F.col("_cut"), F.col("value")), *(F.when(F.col("_cut"), F.col(x)) for x in ("_system", "_messages", "_completion"))))
    c = c.drop("_system", "_messages", "_completion", "_cut", "_bodies", "_asked")
    last = lambda a: F.coalesce(F.try_element_at(F.col(a), F.lit(-1)), F.lit(""))
    c = c.select("*", "_ctx.n_system", "_ctx.roles", "_ctx.dkeys", "_ctx.gkeys", "_ctx.gshell", "_ctx.gcontent",
                 "_ctx.resp_h", F.when(~F.col("_ctx.ok"), F.col("_ctx.reason")).alias("ctx_reason")).drop("_ctx")
    return c.withColumn("ctx_dkey", last("dkeys")).withColumn("ctx_gkey", last("gkeys"))


def split_canonical(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good calls, rejects of both stages) from ``canonicalise_all`` output."""
    rejects = (c.where(F.col("reason").isNotNull())
               .select("src_file", "src_ord", F.lit("parse").alias("stage"), "reason", F.col("value").alias("raw"))
               .unionByName(c.where(F.col("reason").isNull() & ~F.col("excluded") & F.col("ctx_reason").isNotNull())
                            .select("src_file", "src_ord", F.lit("context").alias("stage"),
                                    F.col("ctx_reason").alias("reason"), F.col("value").alias("raw"))))
    good = (c.where(F.col("reason").isNull() & ~F.col("excluded") & F.col("ctx_reason").isNull())
            .drop("reason", "excluded", "ctx_reason"))
    return good, rejects


def canonicalise(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E4 on parsed calls -> (calls with context hashes, rejects)."""
    c = canonicalise_all(calls.withColumn("reason", F.lit(None).cast("string")).withColumn("excluded", F.lit(False)))
    return split_canonical(c)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, glob: str | None = None) -> DataFrame:
    """JSONL with an explicit schema (no inference at scale)."""
    r = spark.read
    if schema:
        r = r.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.json(path).withColumn("src_file", F.col("_metadata.file_path")).withColumn(
        "src_ord", F.monotonically_increasing_id())


def file_stem(path_col: Column) -> Column:
    """file name without directory and ``.jsonl`` suffix; Spark gives paths
    percent-encoded, names come back decoded."""
    stem = F.regexp_extract(path_col, r"([^/]*)\.jsonl$", 1)
    return F.coalesce(F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), stem)


def encode_calls(calls: DataFrame) -> DataFrame:
    """Parsed calls back to raw JSON rows (``value``)."""
    body = F.struct(
        F.try_variant_get(F.col("request"), "$.messages", "variant").alias("messages"),
        F.try_variant_get(F.col("request"), "$.system", "variant").alias("system"),
        F.try_variant_get(F.col("request"), "$.tools", "variant").alias("tools"),
        F.col("model"), F.col("max_tokens"),
        F.try_variant_get(F.col("request"), "$.metadata", "variant").alias("metadata"))
    rec = F.struct("session_id", "biz_id", "request_time", body.alias("request_body"),
                   F.struct(F.try_variant_get(F.col("response"), "$.content", "variant").alias("content"))
                   .alias("response_body"))
    return calls.select(F.to_json(rec).alias("value"))


CASES_SCHEMA = ("instance_id string, user_query array<string>, system_prompt string, category string, "
                "image string, workspace_abs_path string, scaffold struct<name:string, version:string>, "
                "checklist string")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """S5 + S6: task cases from JSONL (or parquet), duplicate ids -> last line wins.

    The checklist of a JSONL case is kept as VARIANT, and as its own text,
    whose keys have the order of the file.
    """
    from ..operators.cases import last_wins
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path).withColumn("src_file", F.col("_metadata.file_path")) \
            .withColumn("src_block", F.col("_metadata.file_block_start")).withColumn("src_ord", F.monotonically_increasing_id())
    else:
        lines = read_lines(spark, path)
        v = F.try_parse_json(F.col("value"))
        raw = lines.select(
            F.try_variant_get(v, "$.instance_id", "string").alias("instance_id"),
            F.try_variant_get(v, "$.user_query", "array<string>").alias("user_query"),
            F.try_variant_get(v, "$.system_prompt", "string").alias("system_prompt"),
            F.try_variant_get(v, "$.category", "string").alias("category"),
            F.try_variant_get(v, "$.image", "string").alias("image"),
            F.try_variant_get(v, "$.workspace_abs_path", "string").alias("workspace_abs_path"),
            F.try_variant_get(v, "$.scaffold", "struct<name:string,version:string>").alias("scaffold"),
            F.try_variant_get(v, "$.checklist", "variant").alias("checklist"),
            F.get_json_object("value", "$.checklist").alias("checklist_text"),
            "src_file", "src_block", "src_ord")
    raw = raw.where(F.col("instance_id").isNotNull())
    return last_wins(raw, "instance_id", ["src_file", "src_block", "src_ord"]) \
        .drop("src_file", "src_block", "src_ord")


TRAJECTORY_SCHEMA = (
    "meta variant, "
    "tools array<struct<type:string, function:struct<name:string, description:string, "
    "parameters:struct<type:string, properties:variant, required:array<string>>>>>, "
    "messages array<struct<role:string, content:variant, tool_name:string, reasoning_content:string, "
    "generation:boolean, tool_calls:array<struct<name:string, arguments:variant>>>>")


def read_trajectories(spark: SparkSession, path: str, mode: str = "file") -> DataFrame:
    """Merged trajectories with a session key and file order.

    ``mode='file'``: every file under ``path``; session = ``meta.session_id``
    (empty ones ignored).  ``mode='dir'``: the ``*.jsonl`` files directly in
    ``path``; session = file stem.  ``meta`` is a variant with all keys of the
    file, the caller's own among them.
    """
    r = spark.read.schema(TRAJECTORY_SCHEMA)
    if mode == "dir":
        df = r.option("pathGlobFilter", "*.jsonl").json(path)
        key = file_stem(F.col("_metadata.file_path"))
    else:
        df = r.option("recursiveFileLookup", "true").json(path)
        key = F.try_variant_get(F.col("meta"), "$.session_id", "string")
    return df.select(key.alias("session_id"), "meta", "tools", "messages",
                     F.col("_metadata.file_path").alias("src_file"),
                     F.struct(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block_start"),
                              F.monotonically_increasing_id().alias("ord")).alias("file_order")).where(
        F.col("session_id").isNotNull() & (F.col("session_id") != ""))
