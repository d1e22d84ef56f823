"""Row filters (pushed down by Catalyst where the source allows)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------
# Model-name words whose calls are excluded (case-insensitive substring).
DEFAULT_EXCLUDED_MODELS = ("haiku",)
# ------------------------------------------------------------------------------


def model_allowed(model: Column, excluded: Iterable[str] = DEFAULT_EXCLUDED_MODELS) -> Column:
    """True unless the lower-cased model name contains an excluded word.

    A missing (NULL) or empty model is kept, unlike a bare ``NOT LIKE``.
    """
    m = F.lower(F.coalesce(model, F.lit("")))
    cond = F.lit(True)
    for w in excluded:
        cond = cond & ~m.contains(w.lower())
    return cond


def exclude_models(df: DataFrame, model_col: str | Column = "model",
                   excluded: Iterable[str] = DEFAULT_EXCLUDED_MODELS) -> DataFrame:
    col = F.col(model_col) if isinstance(model_col, str) else model_col
    return df.where(model_allowed(col, excluded))


def successful(df: DataFrame, success_col: str = "success") -> DataFrame:
    """Only successful provider calls are logged."""
    return df.where(F.coalesce(F.col(success_col), F.lit(False)))


def only_case(df: DataFrame, case_id: str | None, id_col: str = "instance_id") -> DataFrame:
    """Optional single-case filter."""
    return df if case_id is None else df.where(F.col(id_col) == F.lit(case_id))
