"""Task cases keyed by id and matched to trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """One row per ``key``, the last by ``order_cols`` (a ``max_by`` aggregate)."""
    others = [c for c in df.columns if c != key]
    payload = F.struct(*[F.col(c) for c in others])
    rank = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(key).agg(F.max_by(payload, rank).alias("_r")).select(key, "_r.*")


def first_wins(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """One row per ``key``, the first by ``order_cols``."""
    others = [c for c in df.columns if c != key]
    payload = F.struct(*[F.col(c) for c in others])
    rank = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(key).agg(F.min_by(payload, rank).alias("_r")).select(key, "_r.*")


def match_cases(cases: DataFrame, trajectories: DataFrame, case_key: str, traj_key: str) -> DataFrame:
    """Cases that have a trajectory (inner equi-join)."""
    return cases.join(trajectories, cases[case_key] == trajectories[traj_key], "inner")


def missing_cases(cases: DataFrame, trajectories: DataFrame, case_key: str, traj_key: str) -> DataFrame:
    """J5 report: cases without any trajectory (anti join)."""
    return cases.join(trajectories, cases[case_key] == trajectories[traj_key], "left_anti")


def has_trajectory(cases: DataFrame, trajectories: DataFrame, case_key: str, traj_key: str,
                   out_col: str = "has_trajectory") -> DataFrame:
    """Existence flag per case (left join on the distinct keys)."""
    keys = trajectories.select(F.col(traj_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return (cases.join(keys, cases[case_key] == keys["_k"], "left")
            .withColumn(out_col, F.coalesce(F.col("_hit"), F.lit(False))).drop("_k", "_hit"))
