"""Provider events -> raw call records (the collect stage).

A provider event (F-B shape: ``ts, success, model, max_tokens,
optional_params, system, messages, tools, choices``; payloads as VARIANT)
becomes the raw call row the merge stage reads.  Only successful events of
non-excluded models are kept; the session is the run announced last at or
before the event (J7).  All of it is column expressions plus one as-of
join; nothing per-event runs in Python.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attribute import UNKNOWN_RUN, asof_attribute
from .convert import normalize_system, source_tools, vget
from .filters import DEFAULT_EXCLUDED_MODELS, model_allowed

# ---- fixed values ---------------------------------------------------------------
DEFAULT_MAX_TOKENS = 8192  # max_tokens of a call that states none
# ---------------------------------------------------------------------------------


def _truthy_str(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def response_blocks(choices: Column) -> Column:
    """First choice -> thinking blocks, then non-empty text, then tool uses.

    Tool arguments given as text are parsed; unparsable text becomes
    ``{"raw": text}``; arguments that are already objects pass through.
    """
    msg = vget(F.try_element_at(vget(choices, "$", "array<variant>"), F.lit(1)), "$.message")
    thinking = F.coalesce(vget(msg, "$.thinking_blocks", "array<variant>"), F.array().cast("array<variant>"))
    think_blocks = F.transform(thinking, lambda b: F.to_variant_object(F.struct(
        F.lit("thinking").alias("type"), F.coalesce(vget(b, "$.thinking", "string"), F.lit("")).alias("thinking"))))
    text = vget(msg, "$.content", "string")
    text_block = F.when(_truthy_str(text).isNotNull(), F.array(F.to_variant_object(F.struct(
        F.lit("text").alias("type"), text.alias("text"))))).otherwise(F.array().cast("array<variant>"))
    calls = F.coalesce(vget(msg, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))

    def tool_use(tc):
        fn = vget(tc, "$.function")
        args_v = vget(fn, "$.arguments")
        args_s = vget(fn, "$.arguments", "string")
        is_text = F.regexp_extract(F.schema_of_variant(args_v), r"^([A-Z]+)", 1) == "STRING"
        parsed = F.when(fn.isNull(), F.parse_json(F.lit("{}"))).when(
            is_text, F.coalesce(F.try_parse_json(args_s),
                                F.to_variant_object(F.struct(args_s.alias("raw"))))).otherwise(args_v)
        return F.to_variant_object(F.struct(
            F.lit("tool_use").alias("type"), vget(tc, "$.id", "string").alias("id"),
            F.coalesce(vget(fn, "$.name", "string"), F.lit("")).alias("name"),
            F.coalesce(parsed, F.parse_json(F.lit("{}"))).alias("input")))
    return F.concat(think_blocks, text_block, F.transform(calls, tool_use))


def provider_events_of(lines: DataFrame) -> DataFrame:
    """JSON lines (``value`` and any other columns) -> typed provider events.

    ``reason`` tells what is wrong with a line: ``bad_json`` (no object) or
    ``bad_event`` (no time, or ``success`` no boolean); it is NULL on events."""
    v = F.col("_v")
    ts = F.try_to_timestamp(vget(v, "$.ts", "string"))
    df = lines.withColumn("_v", F.try_parse_json("value"))
    is_object = F.regexp_extract("value", r"^\s*(\S)", 1) == "{"
    success = vget(v, "$.success")
    bad_flag = success.isNotNull() & ~F.is_variant_null(success) & vget(success, "$", "boolean").isNull()
    reason = F.when(v.isNull() | ~is_object, "bad_json").when(ts.isNull() | bad_flag, "bad_event")
    return df.select(
        *lines.columns, ts.alias("ts"), vget(success, "$", "boolean").alias("success"), vget(v, "$.model", "string").alias("model"),
        vget(v, "$.max_tokens", "bigint").alias("max_tokens"), *[vget(v, f"$.{c}").alias(c) for c in
                                                                  ("optional_params", "system", "messages", "tools", "choices")],
        reason.alias("reason"))


def normalize_provider_events(events: DataFrame, announcements: DataFrame | None = None,
                              excluded_models: Iterable[str] = DEFAULT_EXCLUDED_MODELS,
                              extra_cols: dict[str, Column] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """P2 + P1 + P6-P9 (+ J7, E1): provider events -> raw call rows with a ``value`` line.

    ``announcements``: ``ts, instance_id`` of run starts; without them every
    call is attributed to ``unknown``.  ``extra_cols`` adds fields to the
    record (the reference's subclass hook); ``keep`` names columns of the events
    that stay beside it.
    """
    ev = events.where(F.coalesce(F.col("success"), F.lit(False)))
    ev = ev.where(model_allowed(_truthy_str(F.col("model")), excluded_models))
    if announcements is not None:
        ev = asof_attribute(ev, announcements, call_ts="ts", ann_ts="ts", ann_id="instance_id",
                            out_col="session_id")
    else:
        ev = ev.withColumn("session_id", F.lit(UNKNOWN_RUN))
    opt = F.col("optional_params")
    system = F.coalesce(_variant_truthy(vget(opt, "$.system")), F.col("system"))
    max_tokens = F.coalesce(F.when(vget(opt, "$.max_tokens", "bigint") != 0, vget(opt, "$.max_tokens", "bigint")),
                            F.col("max_tokens"), F.lit(DEFAULT_MAX_TOKENS))
    tools = F.transform(source_tools(vget(F.col("tools"), "$", "array<variant>")), lambda t: F.to_variant_object(t))
    body = F.struct(F.coalesce(F.col("messages"), F.parse_json(F.lit("[]"))).alias("messages"),
                    normalize_system(system).alias("system"), tools.alias("tools"),
                    F.coalesce(F.col("model"), F.lit("")).alias("model"), max_tokens.alias("max_tokens"),
                    F.parse_json(F.lit("{}")).alias("metadata"))
    content = response_blocks(F.col("choices"))
    fields = [F.col("session_id"), F.lit("").alias("biz_id"),
              F.unix_millis(F.col("ts").cast("timestamp")).alias("request_time"),
              body.alias("request_body"), F.struct(content.alias("content")).alias("response_body")]
    for name, c in (extra_cols or {}).items():
        fields.append(c.alias(name))
    rec = F.struct(*fields)
    return ev.select(
        F.col("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("request_time"),
        F.to_json(rec).alias("value"),
        F.transform(content, lambda b: vget(b, "$.type", "string")).alias("content_types"), *keep)


def _variant_truthy(v: Column) -> Column:
    """Python truthiness of a JSON value: null, '', [], {}, 0 and false are falsy."""
    k = F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)
    falsy = (F.is_variant_null(v)
             | ((k == "STRING") & (vget(v, "$", "string") == ""))
             | ((k == "ARRAY") & (F.size(vget(v, "$", "array<variant>")) == 0))
             | ((k == "OBJECT") & (F.size(vget(v, "$", "map<string,variant>")) == 0))
             | ((k == "BOOLEAN") & ~vget(v, "$", "boolean"))
             | (k.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")
                & (vget(v, "$", "double") == 0)))
    return F.when(v.isNotNull() & ~falsy, v)
