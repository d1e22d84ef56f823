"""Plan checks: equi-form dedup, narrow exchanges, pushdown."""

from fixtures import make_log, write_log
from pyspark.sql import functions as F

from relaytrace.operators.dedup import prefix_dedup
from relaytrace.plans.merge import prepare_calls
from relaytrace.sources.calls import read_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_plan_is_equi_and_narrow(spark, tmpdir_run):
    write_log(f"{tmpdir_run}/in", make_log(seed=5, n_sessions=6))
    calls, _ = prepare_calls(read_lines(spark, f"{tmpdir_run}/in"))
    keys = calls.select("session_id", "call_order", "ctx_dkey", "dkeys")
    kept = prefix_dedup(keys.select("session_id", "call_order", F.explode("dkeys").alias("dkey")), keys)
    plan = _plan(kept)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # payload columns never reach the dedup exchanges (pruned at the materialised scan)
    for payload in ("value", "request", "response"):
        assert f" {payload}#" not in plan and f"[{payload}#" not in plan and f", {payload}#" not in plan


def test_catalogue_scan_prunes_and_pushes(spark):
    import __spark_entry__ as entry
    df = entry.queries()["model_exclusion"](spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint>" in plan
    # the attribution's inputs are materialised before its last scan, so their filter is looked at here
    from relaytrace.sources.tables import read_table
    ev = read_table(spark, "/root/testdata/sf0.001", "events")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)]" in _plan(ev.where("event_type = 'signup'"))


def test_attribution_forms_no_pairs(spark):
    import __spark_entry__ as entry
    plan = _plan(entry.queries()["session_attribution"](spark, "/root/testdata/sf0.001"))
    # the only join brings one carried value to each partition
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 1 and "_gpart" in plan
