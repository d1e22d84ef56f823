"""Merge job: raw call logs -> deduplicated, replayed, converted trajectories.

    text scan -> parse (S2/S3, P1) -> canonical hashes (E4, Arrow UDF)
      -> written once to the shared checkpoint folder (lineage cut, pruned reads)
      -> where most sessions have one call, J1 and J2 look at the others only
      -> J1 prefix dedup on keys only          (aggregate by (session, key))
      -> J2 rank-join replay on keys only      (windows by (session, context key))
         + E5 exact replay for non-neutral sessions (hashes only)
      -> payloads joined back for kept calls only
      -> in-row conversion (P6-P18, J3, J4), P4/P5 -> trajectories + rejects

Payloads never cross the dedup/replay exchanges: those see session ids,
order tuples and 32-byte keys.  Rejected rows are kept with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.convert import DEFAULT_MIN_ASSISTANT_TURNS, convert_all, overlaid_meta, split_converted
from ..operators.dedup import prefix_dedup
from ..operators.filters import DEFAULT_EXCLUDED_MODELS
from ..operators.replay import frontier_replay, kept_context_rows, mark_generation
from ..session import scratch_path
from ..sources.calls import canonicalise_all, parse_all, read_lines, split_canonical


@dataclass
class MergeResult:
    trajectories: DataFrame
    rejects: DataFrame
    calls: DataFrame
    kept: DataFrame


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare_calls(lines: DataFrame, excluded_models=DEFAULT_EXCLUDED_MODELS,
                  model_path: str = "any", persist: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lines (``value, src_file, src_block, src_ord``) -> hashed calls + rejects."""
    # parse and hash every line, write once, then split: a filter on the
    # computed reason would otherwise be pushed into (and repeat) the parse
    c = canonicalise_all(parse_all(lines, excluded_models, model_path))
    if persist:
        c = materialize(c, "calls")
    return split_canonical(c)


def _ctx(calls: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(
        F.col("roles").alias("role"), F.col("dkeys").alias("dkey"), F.col("gkeys").alias("gkey"),
        F.transform("gkeys", lambda x, i: F.when(i == 0, F.lit("")).otherwise(F.col("gkeys")[i - 1])).alias("h"),
        F.col("gcontent").alias("content_h"))
    return (calls.select("session_id", "call_order", "n_system", F.posexplode(zipped).alias("pos", "_e"))
            .select("session_id", "call_order", "n_system", F.col("pos").cast("bigint").alias("pos"), "_e.*"))


def replay_flags(calls: DataFrame, kept: DataFrame, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(turn flags by session, call_order, pos, src_order) and (final flags).

    Neutral sessions take the one-pass rank join; the others are replayed
    exactly by the distributed level-frontier replay.
    """
    ctx = _ctx(kept)
    occ = ctx.where((F.col("role") == "assistant") & (F.col("pos") >= F.col("n_system"))).select(
        "session_id", "call_order", "pos", "h", "content_h")
    providers = calls.select("session_id", "call_order", "ctx_gkey", "resp_h")
    turns, finals = mark_generation(occ, kept.select("session_id", "call_order", "ctx_gkey"), providers)
    if not exact:
        return turns.drop("neutral"), finals
    # flags are hashes only: write them once, then look for non-neutral sessions
    turns = materialize(turns, "turn-flags")
    bad = turns.where(~F.col("neutral")).select("session_id").distinct()
    if bad.isEmpty():
        return turns.drop("neutral"), finals
    turns_n = turns.join(bad, "session_id", "left_anti").drop("neutral")
    finals_n = finals.join(bad, "session_id", "left_anti")

    kb = kept.join(bad, "session_id", "left_semi")
    ex_turns, ex_finals = frontier_replay(
        kept_context_rows(kb), kb.select("session_id", "call_order", "ctx_gkey", F.size("roles").alias("n")),
        calls.join(bad, "session_id", "left_semi").select("session_id", "call_order", "ctx_gkey", "resp_h"))
    return turns_n.unionByName(ex_turns), finals_n.unionByName(ex_finals)


def _several_calls(calls: DataFrame) -> DataFrame | None:
    """Sessions of several calls, or None where most calls are in such sessions.

    A session's only call has nothing to be compared with: no later call extends
    its context, so it is kept; every history in it is shorter than the context it
    answers, so none takes its response and its final response is its own."""
    counts = materialize(calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")), "sessions")
    n, lone = counts.agg(F.sum("n"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0))).first()
    if not n or 2 * lone < n:
        return None
    return materialize(counts.where("n > 1").select("session_id"), "several")


def merge_calls(spark: SparkSession, path: str, min_assistant_turns: int = DEFAULT_MIN_ASSISTANT_TURNS,
                excluded_models=DEFAULT_EXCLUDED_MODELS, model_path: str = "any",
                exact: bool = True, persist: bool = True, match: str = "position") -> MergeResult:
    """S1 scan of every file under ``path`` followed by ``merge_lines``."""
    return merge_lines(read_lines(spark, path), min_assistant_turns, excluded_models, model_path, exact, persist, match)


def merge_lines(lines: DataFrame, min_assistant_turns: int = DEFAULT_MIN_ASSISTANT_TURNS,
                excluded_models=DEFAULT_EXCLUDED_MODELS, model_path: str = "any",
                exact: bool = True, persist: bool = True, match: str = "position") -> MergeResult:
    """Merge already-read lines (``value, src_file, src_block, src_ord``)."""
    calls, rejects = prepare_calls(lines, excluded_models, model_path, persist)
    keys = calls.select("session_id", "call_order", "ctx_dkey", "ctx_gkey", "n_system", "roles", "dkeys",
                        "gkeys", "gshell", "gcontent", "resp_h")
    several = _several_calls(calls) if persist else None
    shared = keys if several is None else keys.join(several, "session_id", "left_semi")
    dctx = shared.select("session_id", "call_order", F.explode("dkeys").alias("dkey"))
    kept_keys = prefix_dedup(dctx, shared).where("kept").drop("kept")
    if persist:
        kept_keys = materialize(kept_keys, "kept")  # read by every branch of the replay
    turns, finals = replay_flags(shared, kept_keys, exact)

    # replacement content of generated turns: the providing call's response blocks
    resp = calls.select("session_id", F.col("call_order").alias("src_order"),
                        F.try_variant_get(F.col("response"), "$.content", "variant").alias("sub"))
    subs = (turns.join(resp, ["session_id", "src_order"], "left")
            .select("session_id", "call_order",
                    F.struct((F.col("pos") - F.lit(0)).alias("pos"), "generation", "sub").alias("_t")))
    per_call = (subs.groupBy("session_id", "call_order").agg(F.collect_list("_t").alias("_ts")))
    ids = ["session_id", "call_order"]
    if several is None:
        rows = calls.join(kept_keys.select(*ids), ids, "left_semi").join(per_call, ids, "left").join(finals, ids, "left")
    else:
        # the flags are joined among themselves first, so payloads are joined once,
        # and stay where they are if the flags are few
        flags = (shared.select(*ids).distinct().withColumn("_shared", F.lit(True))
                 .join(kept_keys.select(*ids).distinct().withColumn("_kept", F.lit(True)), ids, "left")
                 .join(per_call, ids, "left").join(finals, ids, "left"))
        rows = calls.join(materialize(flags, "flags"), ids, "left").where("_shared IS NULL OR _kept")
        rows = rows.withColumn("final_generation", F.coalesce("final_generation", F.col("_shared").isNull())).drop("_shared", "_kept")
        kept_keys = kept_keys.unionByName(keys.join(several, "session_id", "left_anti"))
    rows = rows.withColumn("gen_map", F.map_from_entries(F.transform(
        F.coalesce(F.col("_ts"), F.array().cast("array<struct<pos:bigint,generation:boolean,sub:variant>>")),
        lambda t: F.struct((t["pos"] - F.col("n_system")).cast("int").alias("k"),
                           F.struct(t["generation"].alias("generation"),
                                    F.when(t["generation"], t["sub"]).alias("sub")).alias("v")))))
    converted = convert_all(rows, min_assistant_turns, match)
    if persist:
        # written once: both outputs split from it, and the optimizer cannot
        # push the reject filter into (and so duplicate) the conversion
        converted = materialize(converted, "converted")
    traj, rej3 = split_converted(converted)
    return MergeResult(traj, rejects.unionByName(rej3), calls, kept_keys.drop("resp_h"))


def write_chunks(traj: DataFrame, out: str, chunk_size: int = 10000, num_buckets: int = 100, stem: str = "trajectories") -> list[str]:
    """S9/W6/W7 exactly: JSONL files of ``chunk_size`` rows (the last may have
    fewer) in output order, ``<stem>_partNNN.jsonl`` from 001, or one
    ``<stem>.jsonl`` where one suffices.  Returns the names, in order.

    Rows are numbered over the whole table in (session bucket, session, call
    order) order; a chunk is one group of ``chunk_size`` numbers, written by one
    task, and no task needs more than a chunk at a time.  The driver only renames
    files.  An empty table gives one empty file."""
    from ..functions.keys import global_row_index, md5_bucket

    spark = traj.sparkSession
    rows = traj.select("session_id", "call_order", md5_bucket(F.col("session_id"), num_buckets).alias("_bucket"),
                       F.to_json(F.struct(overlaid_meta(F.col("meta")).alias("meta"), "tools", "messages")).alias("value"))
    # equal keys are told apart by the row's text, so the numbering is one order
    rows = global_row_index(rows, ["_bucket", "session_id", "call_order", "value"], "_row")
    rows = rows.withColumn("_chunk", F.floor((F.col("_row") - 1) / F.lit(chunk_size)).cast("bigint"))
    aside = f"{out.rstrip('/')}/_chunks"
    (rows.repartition("_chunk").sortWithinPartitions("_chunk", "_row").select("_chunk", "value")
     .write.mode("overwrite").partitionBy("_chunk").text(aside))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for folder in fs.listStatus(path(aside)):
        name = folder.getPath().getName()
        if name.startswith("_chunk="):
            found[int(name.split("=")[1])] = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
    names = []
    for k in sorted(found):
        if len(found[k]) != 1:
            raise RuntimeError(f"chunk {k} was written in {len(found[k])} files")
        names.append(f"{stem}_part{k + 1:03d}.jsonl" if len(found) > 1 else f"{stem}.jsonl")
        target = path(f"{out.rstrip('/')}/{names[-1]}")
        fs.delete(target, False)
        fs.rename(found[k][0], target)
    if not names:
        names.append(f"{stem}.jsonl")
        fs.create(path(f"{out.rstrip('/')}/{names[0]}"), True).close()
    fs.delete(path(aside), True)
    return names


def write_trajectories(traj: DataFrame, out: str, chunk_size: int = 10000, single_file: bool = False,
                       ordered: bool = False, num_buckets: int = 100) -> None:
    """JSONL sink; at most ``chunk_size`` rows per file, the caller's
    metadata overlaid into ``meta``.

    ``ordered`` (W7) writes in (session bucket, session, call order) order -
    a range-partitioned sort, so files are ordered too; unordered by default.
    ``write_chunks`` gives files of exactly ``chunk_size`` rows.
    """
    w = traj
    if ordered:
        from ..functions.keys import md5_bucket
        w = w.orderBy(md5_bucket(F.col("session_id"), num_buckets), "session_id", "call_order")
    w = w.select(overlaid_meta(F.col("meta")).alias("meta"), "tools", "messages")
    if single_file:
        w = w.coalesce(1)
    w.write.mode("overwrite").option("maxRecordsPerFile", chunk_size).json(out)
