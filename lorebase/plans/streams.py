"""Queries that run as streams and must equal their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.plans.registry import query
from lorebase.plans.retrieval import CHUNKS
from lorebase.streaming import state
from lorebase.streaming import tables as S


@query("z1_incremental_index", f"WITH {CHUNKS} SELECT source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM chunks JOIN documents USING (doc_id) GROUP BY source")
def incremental_index(spark, d):
    c = S.indexed_chunks(spark, f"{d}/documents.parquet")
    return c.groupBy("source").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


@query("z6_trace_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, min(epoch_us(ts)) AS start_us FROM s GROUP BY user_id, k")
def trace_sessions(spark, d):
    out = S.session_rollup(spark, f"{d}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(start AS TIMESTAMP_NTZ))")
    return out.select("user_id", "n", micros.alias("start_us"))


@query("z4_result_cache", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS cached FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL")
def result_cache(spark, d):
    return S.cached_results(spark, f"{d}/events.parquet")


@query("z6_trace_counters", """WITH s AS (SELECT user_id AS trace_id, event_id AS span_id, event_type = 'purchase' AS is_root, event_type = 'error' AS failed, value FROM events),
t AS (SELECT trace_id, min(span_id) FILTER (is_root) AS root_id, count(*) AS n_spans, count(*) FILTER (failed) AS n_failed, round(coalesce(sum(value), 0), 4) AS value FROM s GROUP BY trace_id)
SELECT * FROM t WHERE root_id IS NOT NULL""")
def trace_counters(spark, d):
    """Events of a user are spans of a trace, the first purchase its root; users without one are still waiting."""
    spans = lambda e: e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), (F.col("event_type") == "purchase").alias("is_root"), (F.col("event_type") == "error").alias("failed"), "value")
    out = state.trace_counters(spark, f"{d}/events.parquet", spans)
    return out.where("complete").select("trace_id", "root_id", "n_spans", "n_failed", F.round("value", 4).alias("value"))


@query("z4_expiring_cache", "SELECT user_id || ':' || event_type AS key, arg_max(event_id, (ts, event_id)) AS result FROM events GROUP BY user_id, event_type")
def expiring_cache(spark, d):
    """The newest result of each key while no key's time is up."""
    results = lambda e: e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("result"), F.col("ts").cast("timestamp").alias("at"))
    return state.expiring_cache(spark, f"{d}/events.parquet", results, 3_600_000).select("key", "result")
