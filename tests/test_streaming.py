"""Stream = batch: incremental merge with a late file equals the batch merge."""

import json
import os

from fixtures import canon, make_log
from pyspark.sql import functions as F

from relaytrace.plans.merge import merge_calls
from relaytrace.streaming.jobs import incremental_merge, read_merge_rejects, read_merged, stream_lines
from relaytrace.streaming.store import EpochStore


def _rows(df):
    return sorted(json.dumps(canon(json.loads(r.j)), sort_keys=True)
                  for r in df.select(F.to_json(F.struct("meta", "tools", "messages")).alias("j")).collect())


def test_incremental_merge_equals_batch(spark, tmpdir_run):
    lines = [x for x in make_log(seed=3, n_sessions=10) if x.strip()]
    src = f"{tmpdir_run}/in"
    chunks = [lines[: len(lines) // 3], lines[len(lines) // 3: 2 * len(lines) // 3], lines[2 * len(lines) // 3:]]
    state, out, ck = f"{tmpdir_run}/state", f"{tmpdir_run}/out", f"{tmpdir_run}/ck"
    for i, chunk in enumerate(chunks):
        os.makedirs(f"{src}/p{i}", exist_ok=True)
        with open(f"{src}/p{i}/calls.jsonl", "w", encoding="utf-8") as fh:
            fh.write("\n".join(chunk) + "\n")
        if i >= 1:  # the third file arrives after the first run (late)
            incremental_merge(spark, stream_lines(spark, f"{src}/*"), state, out, ck, num_buckets=4).awaitTermination()
    res = merge_calls(spark, src)
    streamed, batch = _rows(read_merged(spark, out)), _rows(res.trajectories)
    assert streamed == batch and len(batch) > 0
    reasons = [sorted((r.stage, r.reason, r.raw) for r in x.collect()) for x in (read_merge_rejects(spark, out), res.rejects)]
    assert reasons[0] == reasons[1]


def test_derived_call_log_is_written_by_several_tasks(spark, tmpdir_run, monkeypatch):
    from relaytrace.plans import catalogue

    monkeypatch.setattr(catalogue, "scratch_path", lambda _, name: f"{tmpdir_run}/{name}")
    sf = "/root/testdata/sf0.001"
    log = catalogue.conversation_raw_log
    monkeypatch.setattr(catalogue, "conversation_raw_log", lambda conv: log(conv).repartition(6))
    got = catalogue.QUERIES["incremental_merge"](spark, sf)
    for part in "abc":
        files = [f for f in os.listdir(f"{tmpdir_run}/calls-jsonl/{part}") if f.startswith("part-")]
        assert len(files) > 1, part
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet/**/*.parquet'"
                if os.path.isdir(f"{sf}/conversations.parquet") else f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["incremental_merge"])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def _call(session, turn, text="ok"):
    messages = [m for i in range(turn) for m in ({"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": [{"type": "text", "text": f"a{i}"}]})]
    return {"session_id": session, "request_time": turn, "request_body": {"model": "m", "messages": [*messages, {"role": "user", "content": f"q{turn}"}]},
            "response_body": {"content": [{"type": "text", "text": text}]}}


def _add(folder, calls):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/x.jsonl", "w") as fh:
        fh.write("".join((c if isinstance(c, str) else json.dumps(c)) + "\n" for c in calls))


def _merge(spark, d, **kw):
    incremental_merge(spark, stream_lines(spark, f"{d}/in/*"), f"{d}/state", f"{d}/out", f"{d}/ck", min_assistant_turns=1, **kw).awaitTermination()


def test_a_batch_merges_only_the_sessions_it_touches(spark, tmpdir_run):
    d = tmpdir_run
    _add(f"{d}/in/0", [_call(f"s{i}", t) for i in range(30) for t in (1, 2)] + [{**_call("", 1), "session_id": None}, "{bad"])
    _merge(spark, d, num_buckets=3)
    _add(f"{d}/in/1", [_call("s7", 3), _call("new", 1), "{worse"])
    _merge(spark, d, num_buckets=3)
    facts = EpochStore(spark, f"{d}/out").manifest()["facts"]
    # s7's three lines, the new session's one, the batch's own line without a session
    assert facts["0"] == {"lines": 62, "sessions": 30} and facts["1"] == {"lines": 5, "sessions": 2}
    res = merge_calls(spark, f"{d}/in", min_assistant_turns=1)
    assert _rows(read_merged(spark, f"{d}/out")) == _rows(res.trajectories) and res.trajectories.count() == 31
    assert sorted(r.raw for r in read_merge_rejects(spark, f"{d}/out").collect()) == sorted(r.raw for r in res.rejects.collect())


def test_a_batch_that_died_before_its_commit_leaves_the_old_result(spark, tmpdir_run, monkeypatch):
    d = tmpdir_run
    _add(f"{d}/in/0", [_call("a", 1), _call("b", 1)])
    _merge(spark, d)
    before = _rows(read_merged(spark, f"{d}/out"))
    _add(f"{d}/in/1", [_call("a", 2), _call("c", 1)])
    publish = EpochStore._publish

    def die(self, manifest):
        if self.root.endswith("/out"):
            raise RuntimeError("killed")
        publish(self, manifest)

    monkeypatch.setattr(EpochStore, "_publish", die)
    try:
        _merge(spark, d)
    except Exception:  # noqa: BLE001 - the query fails as a killed driver would
        pass
    monkeypatch.undo()
    assert _rows(read_merged(spark, f"{d}/out")) == before
    _merge(spark, d)  # the same epoch again
    assert _rows(read_merged(spark, f"{d}/out")) == _rows(merge_calls(spark, f"{d}/in", min_assistant_turns=1).trajectories)
    store = EpochStore(spark, f"{d}/out")
    n = len(os.listdir(f"{d}/out/trajectories"))
    store.drop_unnamed()
    assert len(os.listdir(f"{d}/out/trajectories")) == 2 < n
    assert read_merged(spark, f"{d}/out").count() == 3


def test_store_compacts_and_keeps_the_last_rows_of_a_key(spark, tmpdir_run):
    store = EpochStore(spark, f"{tmpdir_run}/s", fanout=3)
    for epoch in range(11):
        rows = spark.createDataFrame([(k, epoch) for k in ("x", f"k{epoch % 4}")], "k string, v int")
        store.commit(epoch, {"rows": rows, "keys": rows.select("k")}, resolve={"rows": ("keys", ["k"])}, sort_by={"rows": ["k"]})
    got = store.latest("rows", "keys", ["k"]).collect()
    assert sorted((r.k, r.v, r.epoch) for r in got) == [("k0", 8, 8), ("k1", 9, 9), ("k2", 10, 10), ("k3", 7, 7), ("x", 10, 10)]
    assert len(store.manifest()["tables"]["rows"]["folders"]) <= 2 * 3
    assert store.read("rows").count() < 22 and store.committed(10) and not store.committed(11)


def test_late_announcements_attribute_calls_anew(spark, tmpdir_run):
    import random

    from relaytrace.streaming.jobs import attribute_streams, read_attributed

    rng, d = random.Random(6), tmpdir_run
    runs, calls, arrived = [], [], 0
    stream = spark.readStream.schema("kind string, id long, ts timestamp, run string").json(f"{d}/in/*")
    for batch in range(4):
        some = [{"kind": "call", "id": arrived + i, "ts": f"2024-01-01T00:{rng.randrange(60):02d}:00Z"} for i in range(12 * (batch < 3))]
        said = [{"kind": "run", "id": 1000 * batch + i, "ts": f"2024-01-01T00:{rng.randrange(60):02d}:00Z", "run": f"r{batch}.{i}"} for i in range(3 if batch != 1 else 0)]
        arrived += len(some)
        calls += some
        runs += said
        _add(f"{d}/in/{batch}", some + said)
        attribute_streams(stream.where("kind = 'call'").select("id", "ts"), stream.where("kind = 'run'").select("ts", F.col("run").alias("instance_id"), F.col("id").alias("said")),
                          f"{d}/out", f"{d}/ck", ["id"], ann_tiebreak="said").awaitTermination()
        want = {c["id"]: max(((r["ts"], r["id"], r["run"]) for r in runs if r["ts"] <= c["ts"]), default=(0, 0, "unknown"))[2] for c in calls}
        rows = read_attributed(spark, f"{d}/out", ["id"]).collect()
        assert {r.id: r.instance_id for r in rows} == want and len(rows) == len(want)
    # the last batch has no calls of its own: it rewrites only those whose run changed
    assert 0 < EpochStore(spark, f"{d}/out").manifest()["facts"]["3"]["rows"] < len(calls)
