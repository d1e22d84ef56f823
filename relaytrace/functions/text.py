"""Text helpers: trimming, middle truncation, fence stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's output text) -----------------
# Truncation limits in characters: tool content, assistant content, reasoning.
TOOL_CONTENT_LIMIT = 5000
ASSISTANT_CONTENT_LIMIT = 50000
REASONING_LIMIT = 50000
# Markers placed between the kept head and tail of a truncated text.
CONTENT_MARKER = "\n\n[content too long, truncated]\n\n"
REASONING_MARKER = "\n\n[reasoning too long, truncated]\n\n"
# Code-fence opener with language tag, bare fence (both removed from judge output).
FENCE_JSON = "```json"
FENCE = "```"
# -----------------------------------------------------------------------------


def py_trim(c: Column) -> Column:
    """Strip leading/trailing Unicode whitespace, newlines included.

    Spark's ``trim`` only removes spaces; this matches ``str.strip()``.
    """
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def middle_truncate(c: Column, limit: int, marker: str = CONTENT_MARKER) -> Column:
    """Over ``limit`` code points: first ``limit//2`` + marker + last ``ceil(limit/2)``.

    Shorter strings pass unchanged and NULL stays NULL.
    """
    head = limit // 2
    tail = -(-limit // 2)
    tail_col = F.substring(c, -tail, tail) if tail > 0 else F.lit("")
    return F.when(F.length(c) > limit,
                  F.concat(F.substring(c, 1, head), F.lit(marker), tail_col)).otherwise(c)


def strip_fences(c: Column) -> Column:
    """Trim; drop a leading ```json, then a leading ```, then a trailing ```; trim."""
    t = py_trim(c)
    t = F.regexp_replace(t, r"\A```json", "")
    t = F.regexp_replace(t, r"\A```", "")
    t = F.regexp_replace(t, r"```\z", "")
    return py_trim(t)
