"""Personal data: candidate spans, boosted trees, calibrated redaction; all of
it DataFrame expressions on the main path.

Four fixed patterns with checks give the base spans.  High-recall generators
propose further, overlapping spans: anything around an at sign and any longer
stretch of digits and separators.  Boosted trees score a candidate by its
format and context; they are fitted on a bounded sample, in which a candidate
counts as personal if a checked base span overlaps it, and calibrated on
held-out candidates.  Candidates at or above the calibrated threshold join the
base spans as kind ``other``.

All spans of a text are found by marking: matches are put between two marks,
the text is split there, and lengths give positions in code points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaytrace.llm.boosting import Boosted, fit
from relaytrace.llm.common import hash_sample, narrow

KINDS = ("email", "ip", "card", "phone", "other")
#: The trees are fitted on the candidates of at most so many documents (picked
#: by hash) of at most so many bytes, and on at most so many candidates.
SAMPLE_DOCS, SAMPLE_DOC_BYTES, SAMPLE_CANDIDATES = 20_000, 16384, 20_000
#: Held-out precision that the calibrated threshold guarantees.
PRECISION = 0.97

# The fixed patterns, each in an equivalent form that Java's matcher runs in
# linear time and constant stack: runs are possessive and start at their first
# character or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of 14 to 19 digits with single separators
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "at": "@",
         "number": r"[0-9][0-9\x20().\-/]{5}"}
GENERATORS = {
    "at": r"(?:(?<![^\s@])|\G)[^\s@]++@[^\s@]++",
    "number": r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,30}",
}
SPAN = "struct<start:int,rank:int,kind:string,end:int,base:boolean>"
_MARK, _NO_MARK = "\u0001", "\u0002"  # the second takes the first's place in a text; neither is in any pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, value, before, after) of a pattern's matches."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def spans(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
        return let(ends, lambda at: F.transform(
            F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
            lambda i: F.struct(at[i].alias("start"), at[i + 1].alias("end"), parts[i].alias("value"),
                               F.right(parts[i - 1], F.lit(24)).alias("before"), F.left(parts[i + 1], F.lit(8)).alias("after"))))

    marked = F.regexp_replace(F.translate(text, _MARK, _NO_MARK), f"({pattern})", f"{_MARK}$1{_MARK}")
    found = let(F.split(marked, _MARK), lambda parts: F.when(F.size(parts) > 2, spans(parts)).otherwise(none))
    return F.when(F.contains(text, F.lit(hint)) if hint == "@" else F.rlike(text, F.lit(hint)), found).otherwise(none)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.left(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return let(digits, _luhn)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Checked matches of the fixed patterns, unsorted, as ``SPAN``."""
    def of(kind: str) -> Column:
        found = F.filter(_matches(text, PATTERNS[kind], HINTS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(found, lambda m: _span(m, kind, base=True))

    return F.concat(*(of(kind) for kind in KINDS[:4]))


def _span(m: Column, kind: str, base: bool) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
                    m["end"].alias("end"), F.lit(base).alias("base"))


def candidates(text: Column) -> Column:
    """What the high-recall generators propose."""
    return F.concat(*(_matches(text, GENERATORS[g], HINTS[g]) for g in GENERATORS))


def features(c: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    v, before, after = c["value"], c["before"], c["after"]
    number = [F.length(v), F.length(F.regexp_replace(v, "[^0-9]", "")), F.length(F.regexp_replace(v, "[^A-Za-z]", ""))]
    number += [F.length(v) - F.length(F.replace(v, F.lit(s), F.lit(""))) for s in (".", "-", " ", "(", "/", "@")]
    number += [F.size(F.split(v, "[^0-9]+")), F.length(F.regexp_extract(v, "^[^0-9]*([0-9]*)", 1)), F.length(F.regexp_extract(v, "([0-9]*)[^0-9]*$", 1)),
               F.length(F.regexp_extract(v, r"@[^.]*(.*)$", 1))]
    flag = [F.startswith(v, F.lit("+")) | F.endswith(before, F.lit("+")), F.rlike(before, F.lit(r"[\p{L}\p{N}_]$")), F.rlike(after, F.lit(r"^[\p{L}\p{N}_]")),
            F.rlike(after, F.lit(r"^[.\-/][0-9]")),
            F.rlike(F.lower(before), F.lit(r"(?:call|phone|tel|fax|mobile|cell|card|visa|account|mail|contact|host|server|\bip)\b\W*\w*\W*$"))]
    return [x.cast("double") for x in number] + [F.coalesce(x, F.lit(False)).cast("double") for x in flag]


def _overlaps(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Boosted:
    """Fit and calibrate the trees on a bounded sample of ``df``; without both
    sorts of candidates in it the model selects nothing."""
    src = narrow(df, id_col, text_col)
    some = hash_sample(src.where(F.octet_length(text_col) <= SAMPLE_DOC_BYTES), [id_col, text_col], SAMPLE_DOCS, total=src.count())
    t = F.col(text_col)
    found = let(base_spans(t), lambda base: F.transform(candidates(t), lambda c: F.struct(
        F.array(*features(c)).alias("x"), _overlaps(c, base).alias("y"), c["value"].alias("v"))))
    rows = some.select(F.explode(found).alias("r")).select("r.x", "r.y", "r.v").orderBy(F.xxhash64("v"), "v", "x", "y").limit(SAMPLE_CANDIDATES).collect()
    if not rows:
        return Boosted(0.0, [])
    x = np.array([r["x"] for r in rows], float)
    return fit(x, np.array([r["y"] for r in rows], bool), precision=PRECISION)


def spans_column(text: Column, model: Boosted) -> Column:
    """All spans of a text as an array of ``SPAN``, by start, then kind."""
    def selected(base: Column) -> Column:
        if not np.isfinite(model.threshold):
            return base
        scored = F.filter(candidates(text), lambda c: ~_overlaps(c, base) & (model.column(features(c)) >= F.lit(model.threshold)))
        return F.concat(base, F.transform(scored, lambda c: _span(c, "other", base=False)))

    return F.array_sort(let(base_spans(text), selected))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """``(id_col, spans)``: the personal data of every whole text, each span with
    start and end in code points (end exclusive), kind, and whether it is a base
    span.  The model is fitted on ``df`` unless one is given.

    A null or empty text has none; a null id stays null; repeated rows are
    searched each; an empty table gives no rows.
    """
    model = train(df, id_col, text_col) if model is None else model
    src = narrow(df, id_col, text_col)
    return src.select(id_col, spans_column(F.col(text_col), model).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one) replaced by its first
    kind in brackets, e.g. ``[EMAIL]``."""
    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        piece = F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """``df`` with the personal data in ``text_col`` redacted; all other columns
    as they are.  A null text stays null."""
    model = train(df, id_col, text_col) if model is None else model
    t = F.col(f"`{text_col}`")
    new = let(spans_column(F.coalesce(t, F.lit("")), model), lambda s: redacted(t, s))
    return df.withColumn(text_col, F.when(t.isNotNull(), new))
