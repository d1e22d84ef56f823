"""Rewards, breakdowns and the summary from per-check verdicts.

Input is a fact table with one row per judged check
(``instance_id, category, check_id, check_type, result``) plus one status
row per case (``instance_id, success, error``).  Everything is a grouped
aggregate (partial aggregation map-side), so one case with a huge checklist
never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import round3_milli

# ---- fixed values --------------------------------------------------------------
SUCCESS = "success"          # the only result value counted as passed
UNKNOWN_CHECK_TYPE = "unknown"  # check type used when a check has none
# --------------------------------------------------------------------------------


def score_cases(status: DataFrame, checks: DataFrame, id_col: str = "instance_id") -> DataFrame:
    """A5 + A7 per case.

    ``reward_milli`` = round(success/total, 3) * 1000 exactly as Python rounds;
    0 on failure or without checks.  ``binary_reward`` is 1 iff the rounded
    reward is 1.0, NULL when the case failed.
    """
    agg = (checks.groupBy(id_col)
           .agg(F.count(F.lit(1)).alias("total_checks"),
                F.count_if(F.col("result") == SUCCESS).alias("total_success")))
    s = status.join(agg, id_col, "left")
    tc = F.coalesce(F.col("total_checks"), F.lit(0)).cast("bigint")
    ts = F.coalesce(F.col("total_success"), F.lit(0)).cast("bigint")
    s = s.withColumn("total_checks", tc).withColumn("total_success", ts)
    milli = F.when(F.col("success"), F.coalesce(round3_milli("total_success", "total_checks"), F.lit(0))) \
             .otherwise(F.lit(0)).cast("bigint")
    return (s.withColumn("total_fail", F.col("total_checks") - F.col("total_success"))
            .withColumn("reward_milli", milli)
            .withColumn("reward", F.col("reward_milli") / F.lit(1000.0))
            .withColumn("binary_reward",
                        F.when(F.col("success"), (F.col("reward_milli") == 1000).cast("int"))))


def detailed_results(checks: DataFrame, categories: DataFrame | None = None,
                     cases: DataFrame | None = None, id_col: str = "instance_id") -> DataFrame:
    """A6 in one pass: totals, per category, per check type.

    ``GROUPING SETS ((id), (id, category), (id, check_type))`` with
    ``grouping_id`` telling the levels apart.  Categories without checks
    (``categories``: id, category) appear with zero counts, and judged
    ``cases`` (id) without any check get a zero total row.
    Output: ``instance_id, level, name, success, fail, total``.
    """
    c = checks
    ok = F.col("result") == SUCCESS
    g = (c.groupingSets([[id_col], [id_col, "category"], [id_col, "check_type"]],
                        id_col, "category", "check_type")
         .agg(F.count_if(ok).alias("success"), F.count_if(~ok | F.col("result").isNull()).alias("fail"),
              F.count(F.lit(1)).alias("total"),
              (F.grouping("category") * 2 + F.grouping("check_type")).alias("_gid")))
    out = g.select(id_col,
                   F.when(F.col("_gid") == 3, F.lit("total"))
                    .when(F.col("_gid") == 1, F.lit("category"))
                    .otherwise(F.lit("check_type")).alias("level"),
                   F.when(F.col("_gid") == 1, F.col("category"))
                    .when(F.col("_gid") == 2, F.col("check_type")).alias("name"),
                   F.col("success").cast("bigint").alias("success"),
                   F.col("fail").cast("bigint").alias("fail"),
                   F.col("total").cast("bigint").alias("total"))
    if categories is not None:
        empty = (categories.select(id_col, F.col("category").alias("name")).distinct()
                 .join(out.where(F.col("level") == "category").select(id_col, "name"), [id_col, "name"], "left_anti")
                 .select(id_col, F.lit("category").alias("level"), "name",
                         F.lit(0).cast("bigint").alias("success"), F.lit(0).cast("bigint").alias("fail"),
                         F.lit(0).cast("bigint").alias("total")))
        out = out.unionByName(empty)
    if cases is not None:
        zero = (cases.select(id_col).distinct()
                .join(out.where(F.col("level") == "total").select(id_col), id_col, "left_anti")
                .select(id_col, F.lit("total").alias("level"), F.lit(None).cast("string").alias("name"),
                        F.lit(0).cast("bigint").alias("success"), F.lit(0).cast("bigint").alias("fail"),
                        F.lit(0).cast("bigint").alias("total")))
        out = out.unionByName(zero)
    return out


def score_summary(scores: DataFrame) -> DataFrame:
    """One row; failures count as reward 0; avg is 0 for no cases."""
    n = F.count(F.lit(1))
    return (scores.agg(n.alias("total"),
                       F.count_if(F.col("success")).alias("success_count"),
                       F.sum("reward_milli").alias("_sum"),
                       F.count_if(F.col("binary_reward") == 1).alias("pass_count"))
            .withColumn("avg_reward_milli",
                        F.coalesce(round3_milli("_sum", "total * 1000"), F.lit(0)).cast("bigint"))
            .withColumn("avg_reward", F.col("avg_reward_milli") / F.lit(1000.0))
            .select(F.col("total").cast("bigint"), F.col("success_count").cast("bigint"),
                    "avg_reward", "avg_reward_milli", F.col("pass_count").cast("bigint")))
