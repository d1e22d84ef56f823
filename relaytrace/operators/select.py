"""Pick the main trajectory of a case and render it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.keys import grouped_cumsum
from .convert import vget
from ..functions.text import (ASSISTANT_CONTENT_LIMIT, CONTENT_MARKER, REASONING_LIMIT,
                              REASONING_MARKER, TOOL_CONTENT_LIMIT, middle_truncate)


def main_trajectory(rows: DataFrame, key: str, order: str, has_tools: Column | str,
                    n_msgs: Column | str, keep: list[str]) -> DataFrame:
    """One row per ``key``.

    Among rows with tools the one with most messages wins (earliest on a
    tie); without any tool-bearing row the last row wins.  ``order`` is any
    orderable column (a struct of file, block and line, say).  Two ``min_by`` /
    ``max_by`` aggregates, so it combines map-side and never gathers a group
    in one task.
    """
    ht = F.col(has_tools) if isinstance(has_tools, str) else has_tools
    nm = F.col(n_msgs) if isinstance(n_msgs, str) else n_msgs
    o = F.col(order)
    payload = F.struct(*[F.col(c) for c in keep])
    most = F.when(ht, F.struct((-nm).alias("n"), o.alias("o")))  # rows without an order are left out
    best = F.coalesce(F.min_by(payload, most), F.max_by(payload, F.when(F.coalesce(~ht, F.lit(True)), o)))
    return (rows.groupBy(key).agg(best.alias("_m"))
            .select(key, *[F.col(f"_m.{c}").alias(c) for c in keep]))


def assistant_turn_index(msgs: DataFrame, part: list[str], order: str, role: str = "role",
                         out: str = "assistant_turn_index") -> DataFrame:
    """W3 on exploded messages: 0-based running count of assistant messages
    (distributed running count, so one huge trajectory is split across tasks)."""
    is_a = F.col(role) == "assistant"
    out_df = grouped_cumsum(msgs, part, [F.col(order)], {"_na": F.when(is_a, 1).otherwise(0)})
    return out_df.withColumn(out, F.when(is_a, F.col("_na") - 1)).drop("_na")


def _cut_variant(v: Column, limit: int) -> Column:
    """A string variant cut in the middle, any other value as it is."""
    is_text = F.schema_of_variant(v) == "STRING"
    return F.when(is_text, middle_truncate(vget(v, "$", "string"), limit, CONTENT_MARKER).cast("variant")).otherwise(v)


def _cut_blocks(content: Column, limit: int) -> Column:
    """List content with the string text of every text block cut on its own."""
    def one(block: Column) -> Column:
        fields = vget(block, "$", "map<string,variant>")
        text = F.schema_of_variant(vget(block, "$.text")) == "STRING"
        cut = F.to_variant_object(F.transform_values(
            fields, lambda k, x: F.when(k == "text", _cut_variant(x, limit)).otherwise(x)))
        return F.when((vget(block, "$.type", "string") == "text") & text, cut).otherwise(block)

    return F.to_variant_object(F.transform(vget(content, "$", "array<variant>"), one))


def truncate_message(m: Column, tool_limit: int = TOOL_CONTENT_LIMIT, assistant_limit: int = ASSISTANT_CONTENT_LIMIT,
                     reasoning_limit: int = REASONING_LIMIT) -> Column:
    """P19 on one converted message struct (role, variant content, reasoning_content, ...).

    Tool content and assistant content that are strings, each text block of an
    assistant's list content, and reasoning keep their head and tail around a
    marker when over their limit.  List content of other roles is left as it is.
    """
    role, content = m["role"], m["content"]
    is_list = vget(content, "$", "array<variant>").isNotNull()
    return m.withField(
        "content",
        F.when(role == "tool", _cut_variant(content, tool_limit))
         .when((role == "assistant") & is_list, _cut_blocks(content, assistant_limit))
         .when(role == "assistant", _cut_variant(content, assistant_limit))
         .otherwise(content)).withField(
        "reasoning_content",
        F.when(role == "assistant", middle_truncate(m["reasoning_content"], reasoning_limit, REASONING_MARKER))
         .otherwise(m["reasoning_content"]))


@F.pandas_udf(StringType())
def indented_json(texts: pd.Series) -> pd.Series:
    """A JSON text over several lines, keys in their own order (one small text a case)."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2))


def index_assistant_turns(messages: Column) -> Column:
    """W3/P20 inside a row: number assistant messages 0.. (NULL elsewhere)."""
    flags = F.transform(messages, lambda m: F.when(m["role"] == "assistant", 1).otherwise(0))
    return F.transform(
        messages,
        lambda m, i: m.withField(
            "assistant_turn_index",
            F.when(m["role"] == "assistant",
                   F.aggregate(F.slice(flags, 1, i + 1), F.lit(0), lambda a, b: a + b) - 1)))


# ---- fixed values: prompt frame (our own wording; the judge sees these) -------
PROMPT_HEADER = "Evaluate the assistant in the conversation below against every check of the checklist."
TOOLS_TAG = "=== TOOLS ==="
MESSAGES_TAG = "=== MESSAGES ==="
CHECKLIST_TAG = "=== CHECKLIST ==="
PROMPT_FOOTER = ('Answer with one JSON object shaped like the checklist, adding "reasoning" and '
                 '"result" ("success" or "fail") to every check.')
# ------------------------------------------------------------------------------


def render_prompt(tool_lines: Column, message_lines: Column, checklist_text: Column) -> Column:
    """Tools and messages one JSON per line, checklist as given."""
    return F.concat_ws("\n", F.lit(PROMPT_HEADER), F.lit(TOOLS_TAG), F.coalesce(tool_lines, F.lit("")),
                       F.lit(MESSAGES_TAG), F.coalesce(message_lines, F.lit("")), F.lit(CHECKLIST_TAG),
                       F.coalesce(checklist_text, F.lit("")), F.lit(PROMPT_FOOTER))
