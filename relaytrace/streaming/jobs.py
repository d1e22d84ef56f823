"""X1-X3 on Structured Streaming.

* X1 ``ingest_stream``: file stream -> per-row transform -> parquet append with
  a checkpoint (S13/S14).  ``ingest_calls`` and ``ingest_provider_events`` write
  two tables, calls and rejects, that are committed together for each epoch.
* X2 ``incremental_merge``: every micro-batch stores its raw lines by session
  and re-merges the sessions it touched, no others.  Late lines just re-merge
  their session, so the result always equals the batch merge of everything
  seen so far; no watermark needed.
* X3 ``attribute_stream``: as-of attribution of each micro-batch against a table
  of announcements; ``attribute_streams`` against a stream of announcements,
  where a late one attributes anew the calls between it and the next.

Results that later epochs may replace live in an ``EpochStore``: a batch shows
whole or not at all, and one that died is replayed without traces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import md5_bucket
from ..operators.attribute import asof_attribute
from ..operators.filters import DEFAULT_EXCLUDED_MODELS
from ..operators.report import DEFAULT_BUCKETS
from ..plans.merge import materialize, merge_lines
from .store import EPOCH, EpochStore

#: Touched sessions up to which a batch names them in the scan's own filter.
NAMED_SESSIONS = 256


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Text file stream (``value, src_file, src_block``); the in-block
    ordinal ``src_ord`` is added per micro-batch (it is not a streaming expression)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.load(path).select("value", F.col("_metadata.file_path").alias("src_file"),
                              F.col("_metadata.file_block_start").alias("src_block"))
    return raw.where(F.col("value").rlike(r"(?U)\S"))


def _start(source: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def ingest_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                  partition_cols: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Apply a per-row ``transform`` and append parquet, exactly once."""
    w = (transform(source).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out))
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# ---- X1: calls and rejects -----------------------------------------------------------

def _commit_calls(store: EpochStore, epoch: int, lines: DataFrame, more_rejects: DataFrame | None, num_buckets: int,
                  excluded_models: Iterable[str]) -> None:
    from ..sources.calls import parse_all, split_parsed

    # parsed once, written once; both tables split from it
    calls, rejects = split_parsed(materialize(parse_all(lines, excluded_models), "ingest"))
    calls = calls.select("session_id", "request_time", "model", "value", "src_file",
                         md5_bucket(F.col("session_id"), num_buckets).alias("bucket"))
    rejects = rejects.select("src_file", "src_ord", "stage", "reason", "raw")
    if more_rejects is not None:
        rejects = rejects.unionByName(more_rejects)
    store.commit(epoch, {"calls": calls, "rejects": rejects}, partition_by={"calls": ["bucket"]}, sort_by={"calls": ["session_id"]})


def ingest_calls(spark: SparkSession, src: str, out: str, checkpoint: str, num_buckets: int = DEFAULT_BUCKETS,
                 available_now: bool = True, excluded_models: Iterable[str] = DEFAULT_EXCLUDED_MODELS) -> StreamingQuery:
    """X1 for raw call lines: calls by session bucket (the merge stage's buckets,
    so batch merges prune to those they need), and every line that is no call
    with its reason.  Read them with ``read_ingested``."""
    store = EpochStore(spark, out)

    def batch(df: DataFrame, epoch: int) -> None:
        if not store.committed(epoch):
            _commit_calls(store, epoch, df.withColumn("src_ord", F.monotonically_increasing_id()), None, num_buckets, excluded_models)

    return _start(stream_lines(spark, src), batch, checkpoint, available_now)


def ingest_provider_events(spark: SparkSession, src: str, out: str, checkpoint: str, announcements: DataFrame | None = None,
                           num_buckets: int = DEFAULT_BUCKETS, available_now: bool = True,
                           excluded_models: Iterable[str] = DEFAULT_EXCLUDED_MODELS,
                           extra_cols: dict[str, Column] | None = None) -> StreamingQuery:
    """X1 for provider events as JSON lines (``ts, success, model, max_tokens,
    optional_params, system, messages, tools, choices``): P2, P1, P6-P9 and E1 make
    them raw calls, attributed to ``announcements`` (J7).  Lines that are no object,
    or have no time, are rejects of stage ``event``."""
    from ..operators.ingest import normalize_provider_events, provider_events_of

    store = EpochStore(spark, out)

    def batch(df: DataFrame, epoch: int) -> None:
        if store.committed(epoch):
            return
        lines = df.withColumn("src_ord", F.monotonically_increasing_id())
        events = materialize(provider_events_of(lines), "events")
        bad = events.where(F.col("reason").isNotNull()).select("src_file", "src_ord", F.lit("event").alias("stage"), "reason", F.col("value").alias("raw"))
        good = events.where(F.col("reason").isNull()).drop("reason", "value")
        rows = normalize_provider_events(good, announcements, excluded_models, extra_cols, keep=["src_file", "src_block", "src_ord"])
        _commit_calls(store, epoch, rows, bad, num_buckets, excluded_models)

    return _start(stream_lines(spark, src), batch, checkpoint, available_now)


def read_ingested(spark: SparkSession, out: str, table: str = "calls") -> DataFrame:
    """Committed ``calls`` or ``rejects`` of an ingest job, with their ``epoch``."""
    rows = EpochStore(spark, out).read(table)
    if rows is None:
        raise ValueError(f"no batch was committed to {out}")
    return rows


# ---- X2: incremental merge --------------------------------------------------------------

def _session_of(line: Column) -> Column:
    """The session a line belongs to; '' where it names none, NULL where the line
    or its session is no JSON text and so belongs to no session."""
    def named(v: Column) -> Column:
        given = F.try_variant_get(v, "$.session_id", "variant")
        return F.when(v.isNull() | (F.schema_of_variant(given) != "STRING"), F.lit(None).cast("string")).otherwise(
            F.coalesce(F.try_variant_get(given, "$", "string"), F.lit("")))

    # the lambda's variable is parsed once, whatever names it
    return F.element_at(F.transform(F.array(F.try_parse_json(line)), named), 1)


def touched_lines(lines: DataFrame, touched: DataFrame, mine: DataFrame) -> DataFrame:
    """Lines of the ``touched`` sessions (``bucket, session_id``) out of all stored
    ``lines``, and the batch's own lines that name no session.

    Buckets prune folders and the sessions' range (their names, where they are
    few) row groups, since files are sorted by session; the semi-join is exact."""
    found = touched.groupBy("bucket").agg(F.min("session_id").alias("lo"), F.max("session_id").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    none = mine.where("session_id IS NULL")
    if not found:  # at most one row a bucket
        return none
    near = lines.where(F.col("bucket").isin([r["bucket"] for r in found])).where(
        F.col("session_id").between(min(r["lo"] for r in found), max(r["hi"] for r in found)))
    if sum(r["n"] for r in found) <= NAMED_SESSIONS:
        near = near.where(F.col("session_id").isin([r["session_id"] for r in touched.select("session_id").collect()]))
    return near.join(touched, ["bucket", "session_id"], "left_semi").unionByName(none)


def incremental_merge(spark: SparkSession, lines: DataFrame, state_dir: str, out: str, checkpoint: str,
                      num_buckets: int = DEFAULT_BUCKETS, min_assistant_turns: int = 3,
                      available_now: bool = True) -> StreamingQuery:
    """Re-merge the sessions a micro-batch touched, and only those.

    ``state_dir`` keeps the raw lines by session bucket, ``out`` the merged rows;
    both are epoch stores.  Each commit's facts hold ``lines`` (lines merged) and
    ``sessions``.  Read the result with ``read_merged`` and ``read_merge_rejects``."""
    raw, merged = EpochStore(spark, state_dir), EpochStore(spark, out)

    def batch(df: DataFrame, epoch: int) -> None:
        if merged.committed(epoch):
            return
        if not raw.committed(epoch):
            staged = (df.withColumn("src_ord", F.monotonically_increasing_id()).withColumn("session_id", _session_of(F.col("value")))
                      .withColumn("bucket", md5_bucket(F.coalesce("session_id", F.lit("")), num_buckets)))
            raw.commit(epoch, {"lines": staged}, partition_by={"lines": ["bucket"]}, sort_by={"lines": ["session_id"]})
        stored = raw.read("lines")
        mine = stored.where(F.col(EPOCH) == epoch)
        touched = materialize(mine.where("session_id IS NOT NULL").select("bucket", "session_id").distinct(), "touched")
        seen = Observation()
        now = touched_lines(stored, touched, mine).select("value", "src_file", "src_block", "src_ord")
        res = merge_lines(now.observe(seen, F.count(F.lit(1)).alias("lines")), min_assistant_turns=min_assistant_turns)
        rejects = materialize(res.rejects.withColumn("session_id", _session_of(F.col("raw"))), "rejects")
        by_session = ("touched", ["session_id"])
        merged.commit(
            epoch,
            {"trajectories": res.trajectories.select("session_id", "call_order", "meta", "tools", "messages", "n_assistant"),
             "rejects": rejects.where("session_id IS NOT NULL"), "line_rejects": rejects.where("session_id IS NULL").drop("session_id"),
             "touched": touched.select("session_id")},
            sort_by={"trajectories": ["session_id"], "rejects": ["session_id"], "touched": ["session_id"]},
            facts=lambda: {"lines": seen.get["lines"], "sessions": touched.count()},
            resolve={"trajectories": by_session, "rejects": by_session})

    return _start(lines, batch, checkpoint, available_now)


def read_merged(spark: SparkSession, out: str) -> DataFrame:
    """Trajectories of ``incremental_merge``: of each session those of the last epoch that touched it."""
    rows = EpochStore(spark, out).latest("trajectories", "touched", ["session_id"])
    if rows is None:
        raise ValueError(f"no batch was committed to {out}")
    return rows.drop(EPOCH)


def read_merge_rejects(spark: SparkSession, out: str) -> DataFrame:
    """Rejects of ``incremental_merge``: of lines without a session all, of a session the last ones."""
    store = EpochStore(spark, out)
    rows = store.latest("rejects", "touched", ["session_id"])
    if rows is None:
        raise ValueError(f"no batch was committed to {out}")
    return rows.drop(EPOCH, "session_id").unionByName(store.read("line_rejects").drop(EPOCH))


# ---- X3: attribution ----------------------------------------------------------------

def attribute_stream(calls: DataFrame, announcements: DataFrame, out: str, checkpoint: str,
                     call_ts: str = "ts", ann_ts: str = "ts", ann_id: str = "instance_id",
                     ann_tiebreak: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Micro-batch as-of attribution; each epoch overwrites its own output folder."""
    def batch(df: DataFrame, epoch: int) -> None:
        res = asof_attribute(df, announcements, call_ts, ann_ts, ann_id, ann_tiebreak)
        res.write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={epoch}")

    return _start(calls, batch, checkpoint, available_now)


def _in_reach(announcements: DataFrame, calls: DataFrame, ann_ts: str, call_ts: str) -> DataFrame:
    """Announcements that some of the calls can belong to: from the last one at or
    before the earliest call to the latest call."""
    lo, hi = calls.agg(F.min(call_ts), F.max(call_ts)).first()
    if lo is None:
        return announcements.limit(0)
    first = announcements.where(F.col(ann_ts) <= F.lit(lo)).agg(F.max(ann_ts)).first()[0]
    return announcements.where((F.col(ann_ts) >= F.lit(lo if first is None else first)) & (F.col(ann_ts) <= F.lit(hi)))


def attribute_streams(calls: DataFrame, announcements: DataFrame, out: str, checkpoint: str, key: list[str],
                      call_ts: str = "ts", ann_ts: str = "ts", ann_id: str = "instance_id", ann_tiebreak: str | None = None,
                      out_col: str = "instance_id", available_now: bool = True) -> StreamingQuery:
    """X3 with both sides as streams: ``key`` tells calls apart.

    A batch attributes its new calls against all announcements so far.  Its new
    announcements may change older calls: those from the earliest of them to the
    next known announcement after the latest of them are scanned again, and rows
    whose run changed are committed with the new epoch.  There is no watermark:
    however late an announcement, the result (``read_attributed``) equals the
    as-of join of everything seen so far."""
    spark = calls.sparkSession
    store = EpochStore(spark, out)
    ann_cols = list(dict.fromkeys([ann_ts, ann_id, *([ann_tiebreak] if ann_tiebreak else [])]))
    sent = calls.select(F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("call"), F.lit(None).cast(announcements.select(*ann_cols).schema).alias("ann"))
    said = announcements.select(F.lit(None).cast(calls.schema).alias("call"), F.struct(*ann_cols).alias("ann"))

    def batch(df: DataFrame, epoch: int) -> None:
        if store.committed(epoch):
            return
        both = materialize(df, "arrivals")
        new_calls, new_ann = both.where("call IS NOT NULL").select("call.*"), both.where("ann IS NOT NULL").select("ann.*")
        old_ann, old = store.read("announcements"), store.read("calls")
        known = new_ann if old_ann is None else old_ann.select(*ann_cols).unionByName(new_ann)
        work = new_calls.withColumn("_old", F.lit(None).cast("string"))
        lo, hi = new_ann.agg(F.min(ann_ts), F.max(ann_ts)).first()
        if old is not None and lo is not None:
            # a call keeps its time, so all versions of the rows lie in the range
            until = known.where(F.col(ann_ts) > F.lit(hi)).agg(F.min(ann_ts)).first()[0]
            span = F.col(call_ts) >= F.lit(lo)
            span = span if until is None else span & (F.col(call_ts) < F.lit(until))
            last = old.where(span).groupBy(*key).agg(F.max(EPOCH).alias(EPOCH))
            now = old.where(span).join(last, [*key, EPOCH], "left_semi")
            work = work.unionByName(now.withColumn("_old", F.col(out_col)).select(*work.columns))
        work = materialize(work, "to-attribute")
        done = asof_attribute(work, _in_reach(known, work, ann_ts, call_ts), call_ts, ann_ts, ann_id, ann_tiebreak, out_col)
        changed = done.where(F.col("_old").isNull() | (F.col("_old") != F.col(out_col))).drop("_old")
        seen = Observation()
        store.commit(epoch, {"calls": changed.observe(seen, F.count(F.lit(1)).alias("rows")), "announcements": new_ann},
                     sort_by={"calls": [call_ts], "announcements": [ann_ts]}, resolve={"calls": ("calls", key)},
                     facts=lambda: {"rows": seen.get["rows"]})

    return _start(sent.unionByName(said), batch, checkpoint, available_now)


def read_attributed(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """Calls of ``attribute_streams``, each with its run as of everything seen so far."""
    rows = EpochStore(spark, out).latest("calls", "calls", key)
    if rows is None:
        raise ValueError(f"no batch was committed to {out}")
    return rows.drop(EPOCH)
