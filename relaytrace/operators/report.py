"""Counts and funnels (all partial-aggregated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import md5_bucket

# ---- fixed values ---------------------------------------------------------------
DEFAULT_SCAFFOLD = "claudecode"  # scaffold of a case that names none
DEFAULT_BUCKETS = 100            # hash buckets of the merge stage
# ---------------------------------------------------------------------------------


def bucket_counts(df: DataFrame, session_col: str = "session_id", num_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """A2/F1: rows per md5 bucket of the session id (non-empty buckets only)."""
    return (df.select(md5_bucket(F.col(session_col).cast("string"), num_buckets).alias("bucket"))
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows")))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """A3: one row per stage with its row count, in one union of aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
             for name, df in stages]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filtered_share(n_in: Column, n_out: Column) -> Column:
    """A3 ratio: share of input rows filtered out; NULL on empty input."""
    return F.try_divide((n_in - n_out).cast("double"), n_in.cast("double"))


def scaffold_name(scaffold: Column) -> Column:
    """The scaffold name, defaulted."""
    return F.coalesce(scaffold, F.lit(DEFAULT_SCAFFOLD))


def scaffold_distribution(cases: DataFrame, scaffold_col: Column) -> DataFrame:
    """Cases per scaffold (defaulted name)."""
    return (cases.select(scaffold_name(scaffold_col).alias("scaffold"))
            .groupBy("scaffold").agg(F.count(F.lit(1)).alias("n_cases")))


def run_success(runs: DataFrame) -> DataFrame:
    """A10: successful runs out of all runs."""
    return runs.agg(F.count_if(F.col("success")).alias("success_count"), F.count(F.lit(1)).alias("total"))


def distinct_sessions(df: DataFrame, session_col: str = "session_id", approx: bool = False) -> DataFrame:
    """Distinct non-empty sessions (HyperLogLog when ``approx``)."""
    s = F.col(session_col)
    nonempty = df.where(s.isNotNull() & (s.cast("string") != ""))
    agg = F.approx_count_distinct(s) if approx else F.count_distinct(s)
    return nonempty.agg(agg.alias("n_sessions"))


def run_results(cases: DataFrame, outcomes: DataFrame, model: str, id_col: str = "instance_id") -> DataFrame:
    """One run row per case: ``instance_id, scaffold (defaulted), model, success``."""
    return (cases.join(outcomes, id_col, "left")
            .select(id_col, scaffold_name(F.col("scaffold.name")).alias("scaffold"), F.lit(model).alias("model"),
                    F.coalesce(F.col("success"), F.lit(False)).alias("success")))


def write_runs(runs: DataFrame, out: str) -> None:
    """Run results as JSON."""
    runs.write.mode("overwrite").json(out)
