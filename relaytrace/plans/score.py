"""Score job: cases x merged trajectories -> judge -> rewards and summary.

    cases (S5/S6) ⋈ main trajectory per session (W2, max_by aggregate)   J5
      -> truncate + index turns (P19/P20, in-row) -> render prompt (P21)
      -> judge (E2, mapInPandas, responses checkpointed once)
      -> parse verdicts (P22) -> checks fact table (A13)
      -> rewards (A5/A7), breakdowns (A6, one GROUPING SETS pass), summary (A8)

Cases without a trajectory are reported by an anti join and excluded from
the totals; cases without a checklist fail before any judge call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cases import match_cases, missing_cases
from ..operators.judge import Scorer, call_judge, parse_verdicts, verdicts
from ..operators.score import detailed_results, score_cases, score_summary
from ..plans.merge import materialize
from ..session import ship_package
from ..operators.select import index_assistant_turns, indented_json, main_trajectory, render_prompt, truncate_message


@dataclass
class ScoreResult:
    scores: DataFrame
    summary: DataFrame
    detailed: DataFrame
    checks: DataFrame
    missing: DataFrame
    prompts: DataFrame
    verdicts: DataFrame


def main_trajectories(traj: DataFrame, order_col: str = "file_order", scope: str = "session", file_col: str = "src_file") -> DataFrame:
    """W2 over merged rows (``meta`` or ``session_id``, ``tools, messages``, ``order_col``).

    ``scope='session'`` picks a session's main row among its own.  ``'file'``
    picks one main row a file among all of the file's rows and gives it to every
    session whose first occurrence (by ``order_col``) is in that file, as the
    single-file mode does; ``file_col`` names the file.  Both are aggregates that
    combine map-side; a file's one row meets its sessions by an equi-join."""
    sid = F.col("session_id") if "session_id" in traj.columns else F.col("meta.session_id")
    if scope not in ("session", "file"):
        raise ValueError(f"scope is 'session' or 'file', not {scope!r}")
    rows = traj.select(sid.alias("session_id"), "tools", "messages", order_col, *([file_col] if scope == "file" else []))
    named = F.col("session_id").isNotNull() & (F.col("session_id") != "")
    if scope == "session":
        return main_trajectory(rows.where(named), "session_id", order_col, F.size("tools") > 0, F.size("messages"),
                               ["tools", "messages"])
    best = main_trajectory(rows, file_col, order_col, F.size("tools") > 0, F.size("messages"), ["tools", "messages"])
    first = rows.where(named).groupBy("session_id").agg(F.min_by(file_col, order_col).alias(file_col))
    return first.join(best, file_col).select("session_id", "tools", "messages")


def build_prompts(cases: DataFrame, main: DataFrame, id_col: str = "instance_id",
                  checklist_col: str = "checklist") -> tuple[DataFrame, DataFrame, DataFrame]:
    """J5 + P19-P21 -> (prompts of judgeable cases, pre-judge failures, missing cases).

    The checklist is shown indented; its keys keep their own order where the
    cases carry its text (``<checklist_col>_text``), else they are sorted."""
    ship_package(cases.sparkSession)
    matched = match_cases(cases, main, id_col, "session_id")
    missing = missing_cases(cases, main, id_col, "session_id").select(id_col)
    ck = F.col(checklist_col)
    empty = ck.isNull() | (F.size(F.try_variant_get(ck, "$", "map<string,variant>")) == 0) | \
        F.try_variant_get(ck, "$", "map<string,variant>").isNull()
    no_checklist = matched.where(empty).select(
        id_col, F.lit(False).alias("success"), F.lit("case has no checklist").alias("error"))
    ok = matched.where(~empty)
    msgs = F.transform(index_assistant_turns(F.col("messages")), lambda m: truncate_message(m))
    prompt = render_prompt(F.array_join(F.transform("tools", lambda t: F.to_json(t)), "\n"),
                           F.array_join(F.transform(msgs, lambda m: F.to_json(m)), "\n"),
                           indented_json(F.col(text) if (text := f"{checklist_col}_text") in cases.columns else F.to_json(ck)))
    return ok.select(id_col, prompt.alias("prompt")), no_checklist, missing


def score_job(cases: DataFrame, traj: DataFrame, scorer: Scorer | None = None,
              responses: DataFrame | None = None, id_col: str = "instance_id", checklist_col: str = "checklist",
              order_col: str = "file_order", judge_partitions: int | None = None, scope: str = "session",
              response_store: str | None = None) -> ScoreResult:
    """Either ``scorer`` (called once per prompt) or precomputed ``responses`` (id, response).

    With ``response_store`` answers are kept there and a prompt that has one is
    not judged again (see ``call_judge``); ``scope`` as in ``main_trajectories``."""
    # one main trajectory per session, written once: it feeds several branches
    main = materialize(main_trajectories(traj, order_col, scope), "main-trajectories")
    prompts, no_checklist, missing = build_prompts(cases, main, id_col, checklist_col)
    if responses is None:
        if scorer is None:
            raise ValueError("give a scorer or a responses frame")
        responses = call_judge(prompts, scorer, id_col, partitions=judge_partitions, store=response_store)
    else:
        responses = responses.join(prompts.select(id_col), id_col, "left_semi")
        if "judge_error" not in responses.columns:
            responses = responses.withColumn("judge_error", F.lit(None).cast("string"))
    judged = responses.where(F.col("judge_error").isNull())
    failed = responses.where(F.col("judge_error").isNotNull()).select(
        id_col, F.lit(False).alias("success"), F.col("judge_error").alias("error"))
    status, checks, categories = parse_verdicts(judged, id_col, "response")
    all_status = status.unionByName(failed).unionByName(no_checklist)
    scores = score_cases(all_status, checks, id_col)
    detailed = detailed_results(checks, categories, status.where(F.col("success")).select(id_col), id_col)
    return ScoreResult(scores, score_summary(scores), detailed, checks, missing, prompts, verdicts(judged, id_col))


def write_report(res: ScoreResult, out: str, id_col: str = "instance_id") -> None:
    """Results, each with its verdict (``eval_result``), and summary as JSON tables."""
    res.scores.join(res.verdicts, id_col, "left").write.mode("overwrite").json(f"{out.rstrip('/')}/results")
    res.summary.write.mode("overwrite").json(f"{out.rstrip('/')}/summary")
    res.detailed.write.mode("overwrite").json(f"{out.rstrip('/')}/detailed")
