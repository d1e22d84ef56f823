"""Exact 3-place rounding of a ratio, as Python's ``round(s / t, 3)`` does it.

Python rounds the *binary double* nearest to ``s/t``.  Away from ties that
is ordinary rounding of the rational.  On a tie (``1000*s/t`` ends in
exactly .5) the result depends on whether the double sits on, above or below
the tie: on it (the tie value n/2000 has a power-of-two denominator, i.e.
125 divides n) ties go to even; otherwise the direction in which ``n/2000``
was rounded to 53 bits decides.  All of this is integer arithmetic on
columns, so it runs JVM-side and the same rule is written in SQL for the
oracle (``round3_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _round3(s: str, t: str, spark: bool) -> str:
    idiv = (lambda a, b: f"({a} div {b})") if spark else (lambda a, b: f"({a} // {b})")
    shl = (lambda a, b: f"shiftleft({a}, {b})") if spark else (lambda a, b: f"({a} << {b})")
    one = "CAST(1 AS BIGINT)" if spark else "1::BIGINT"
    f = idiv(f"(CAST({s} AS BIGINT) * 1000)", f"CAST({t} AS BIGINT)")
    r2 = f"((CAST({s} AS BIGINT) * 1000 - {f} * CAST({t} AS BIGINT)) * 2)"
    n = f"({f} * 2 + 1)"
    k = f"(52 - CAST(floor(log2({n} / 2000.0)) AS INTEGER))"
    pm = f"(((" + shl(one, f"({k} - 1)") + ") % 2000) * 2 % 2000)"
    rem = f"(({n} * {pm}) % 2000)"
    tie = (f"CASE WHEN {n} % 125 = 0 THEN (CASE WHEN {f} % 2 = 0 THEN {f} ELSE {f} + 1 END) "
           f"WHEN {rem} * 2 > 2000 THEN {f} + 1 ELSE {f} END")
    return (f"(CASE WHEN CAST({t} AS BIGINT) > 0 THEN (CASE WHEN {r2} < CAST({t} AS BIGINT) THEN {f} "
            f"WHEN {r2} > CAST({t} AS BIGINT) THEN {f} + 1 ELSE {tie} END) END)")


def round3_milli(s: str, t: str) -> Column:
    """``round(s/t, 3) * 1000`` as BIGINT for SQL expressions ``s``, ``t``.

    NULL when ``t`` is 0 or NULL.  Integer arithmetic only (``div``).
    """
    return F.expr(_round3(s, t, spark=True))


def round3_sql(s: str, t: str) -> str:
    """The same rule as a DuckDB SQL expression (for oracles)."""
    return _round3(s, t, spark=False)
