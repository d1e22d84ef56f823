"""Command line: ``python -m relaytrace.cli merge|score ...``.

``merge``: raw call logs (file or directory, recursive) -> trajectories JSONL
(at most ``--chunk_size`` rows per file) plus a rejects table.
``score``: merged trajectories + task cases -> results / summary / detailed
tables.  The judge is a ``module:function`` callable (``list[str] ->
list[str]``) or a JSONL file of precomputed ``{instance_id, response}``.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from .operators.filters import only_case
from .operators.report import filtered_share, funnel
from .plans.merge import merge_calls, write_chunks, write_trajectories
from .plans.score import score_job, write_report
from .session import drop_scratch, get_session
from .sources.calls import read_cases, read_lines, read_trajectories


def merge_report(lines, res, rejects) -> list[str]:
    """A3: rows by stage, the share that was filtered out, rejects by reason, and
    tool results without their call."""
    rows = funnel([("input", lines), ("calls", res.calls), ("kept", res.kept), ("output", res.trajectories)])
    n = {r["stage"]: r["n_rows"] for r in rows.collect()}
    share = rows.sparkSession.range(1).select(filtered_share(F.lit(n["input"]), F.lit(n["output"])).alias("s")).first()["s"]
    out = [f"{stage}: {n[stage]} rows" for stage in ("input", "calls", "kept", "output")]
    out.append("filtered: " + ("no input" if share is None else f"{100 * share:.1f} %"))
    reasons = rejects.groupBy("stage", "reason").count().orderBy("stage", "reason").collect()
    out += [f"rejected ({r['stage']}, {r['reason']}): {r['count']}" for r in reasons]
    lost = res.trajectories.agg(F.sum("dropped_results").alias("n")).first()["n"]
    return [*out, f"tool results not in their call's batch: {lost or 0}"]


def _merge(args) -> None:
    spark = get_session("relaytrace-merge")
    res = merge_calls(spark, args.input_path, min_assistant_turns=args.min_assistant_turns, match=args.match)
    if args.exact_chunks:
        write_chunks(res.trajectories, args.output_path, chunk_size=args.chunk_size, num_buckets=args.num_buckets)
    else:
        write_trajectories(res.trajectories, args.output_path, chunk_size=args.chunk_size)
    rejects = args.output_path.rstrip("/") + "_rejects"
    res.rejects.write.mode("overwrite").json(rejects)
    for line in merge_report(read_lines(spark, args.input_path), res, spark.read.schema("stage string, reason string").json(rejects)):
        print(line)
    drop_scratch(spark)


def _score(args) -> None:
    spark = get_session("relaytrace-score")
    cases = only_case(read_cases(spark, args.data), args.case)
    traj = read_trajectories(spark, args.trajectories, mode="dir" if args.per_case_files else "file")
    scope = "session" if args.per_case_files else args.scope
    if args.responses:
        responses = spark.read.schema("instance_id string, response string").json(args.responses)
        res = score_job(cases, traj, responses=responses, scope=scope)
    else:
        mod, fn = args.judge.split(":")
        res = score_job(cases, traj, scorer=getattr(importlib.import_module(mod), fn),
                        judge_partitions=args.judge_parallelism, scope=scope, response_store=args.response_store)
    write_report(res, args.output)
    res.missing.select(F.col("instance_id")).write.mode("overwrite").json(args.output.rstrip("/") + "/missing")
    drop_scratch(spark)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="relaytrace")
    sub = p.add_subparsers(dest="cmd", required=True)
    m = sub.add_parser("merge", help="deduplicate, replay and convert raw call logs")
    m.add_argument("--input_path", required=True)
    m.add_argument("--output_path", required=True)
    m.add_argument("--min_assistant_turns", type=int, default=3)
    m.add_argument("--chunk_size", type=int, default=10000)
    m.add_argument("--num_buckets", type=int, default=100, help="session buckets of the output order (--exact_chunks)")
    m.add_argument("--exact_chunks", action="store_true", help="ordered <stem>_partNNN.jsonl files of exactly --chunk_size rows")
    m.add_argument("--match", choices=("position", "id"), default="position", help="how tool results meet their calls")
    s = sub.add_parser("score", help="judge main trajectories against case checklists")
    s.add_argument("--trajectories", required=True)
    s.add_argument("--data", required=True, help="task cases (JSONL)")
    s.add_argument("--output", required=True)
    s.add_argument("--case", default=None)
    s.add_argument("--per_case_files", action="store_true", help="one <instance_id>.jsonl per case")
    g = s.add_mutually_exclusive_group(required=True)
    g.add_argument("--judge", help="module:function taking a list of prompts")
    g.add_argument("--responses", help="JSONL of precomputed {instance_id, response}")
    s.add_argument("--judge_parallelism", type=int, default=None)
    s.add_argument("--response_store", default=None, help="folder of judge answers; prompts that have one are not judged again")
    s.add_argument("--scope", choices=("session", "file"), default="session", help="rows among which a case's main trajectory is picked")
    args = p.parse_args(argv)
    (_merge if args.cmd == "merge" else _score)(args)


if __name__ == "__main__":
    main()
