"""Streams with state and timers: restarts in the middle, late rows, expiry."""

import time

from pyspark.sql import functions as F

from lorebase.operators.shared import scratch_path
from lorebase.streaming import state

SPANS = "trace_id long, span_id long, is_root boolean, failed boolean, value double"


def _come(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_counters_wait_for_the_root_and_take_in_late_spans(spark):
    path, home = scratch_path(spark, "spans"), scratch_path(spark, "home")
    run = lambda keep: {r["trace_id"]: tuple(r)[1:] for r in state.trace_counters(spark, path, lambda s: s, keep, home).collect()}
    _come(spark, path, [(1, 2, False, True, 1.0), (1, 3, False, False, None), (2, 9, True, False, 5.0), (3, 20, False, False, 1.0)], SPANS)
    assert run(60_000) == {2: (9, 1, 0, 5.0, True)}  # 1 and 3 wait
    _come(spark, path, [(1, 1, True, False, 2.0)], SPANS)
    assert run(60_000) == {1: (1, 3, 1, 3.0, True), 2: (9, 1, 0, 5.0, True)}  # a restart in the middle of trace 1
    _come(spark, path, [(1, 7, False, True, 4.0)], SPANS)
    got = run(60_000)
    whole = {r["trace_id"]: tuple(r)[1:] for r in state.trace_counters(spark, path, lambda s: s, 60_000).collect()}
    assert got == whole == {1: (1, 4, 2, 7.0, True), 2: (9, 1, 0, 5.0, True)}  # as if it had run once


def test_state_goes_when_its_time_is_up(spark):
    path, home = scratch_path(spark, "spans"), scratch_path(spark, "home")
    held = lambda: {r["key"]["trace_id"] for r in spark.read.format("statestore").option("stateVarName", "held").load(f"{home}/state").collect()}
    run = lambda: {r["trace_id"]: tuple(r)[1:] for r in state.trace_counters(spark, path, lambda s: s, 1, home).collect()}
    _come(spark, path, [(1, 1, True, False, 1.0), (2, 2, False, True, 1.0)], SPANS)
    run()
    time.sleep(0.1)
    _come(spark, path, [(3, 3, False, False, 1.0)], SPANS)
    got = run()
    assert got[1] == (1, 1, 0, 1.0, True) and got[2] == (None, 1, 1, 1.0, False)  # the root of 2 never came
    assert held() <= {3}


def test_cache_expires_by_processing_time(spark):
    path, home = scratch_path(spark, "results"), scratch_path(spark, "home")
    schema = "key string, result long, ts string"
    results = lambda s: s.select("key", "result", F.to_timestamp("ts").alias("at"))
    run = lambda keep: {r["key"]: r["result"] for r in state.expiring_cache(spark, path, results, keep, home).collect()}
    _come(spark, path, [("a", 1, "2024-01-02 00:00:00"), ("a", 2, "2024-01-01 00:00:00"), ("b", 3, "2024-01-01 00:00:00"), (None, 4, "2024-01-01 00:00:00"), ("n", 5, None)], schema)
    assert run(300) == {"a": 1, "b": 3}  # the newest by time, not by arrival
    time.sleep(0.5)
    _come(spark, path, [("c", 6, "2024-01-01 00:00:00")], schema)
    assert run(60_000) == {"c": 6}
    _come(spark, path, [("a", 7, "2023-01-01 00:00:00")], schema)
    assert run(60_000) == {"a": 7, "c": 6}  # an expired key begins anew, however old its result
