"""Queries on traces: events are spans, a user is a trace, the first event its root."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import graph as G
from lorebase.operators import traces as R
from lorebase.plans.registry import query, table

TOKENS = "(props::JSON ->> '$.k')::BIGINT"


@query("a4_trace_rollup", f"SELECT user_id AS trace_id, count(*) AS span_count, count(*) FILTER (event_type = 'view') AS generation_count, count(*) FILTER (event_type = 'click') AS tool_count, count(*) FILTER (event_type = 'error') AS error_count, sum({TOKENS})::BIGINT AS total_tokens, round(sum(value), 4) AS duration_ms, min(event_id) AS first_span FROM events GROUP BY 1")
def trace_rollup(spark, d):
    return R.rollup(R.spans(table(spark, d, "events")))


@query("p15_trace_status", "WITH s AS (SELECT user_id AS trace_id, count(*) FILTER (event_type = 'error') AS e, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) SELECT trace_id, CASE WHEN last = 'error' THEN 'error' WHEN e > 0 THEN 'warning' ELSE 'success' END AS status FROM s")
def trace_status(spark, d):
    return R.statuses(R.spans(table(spark, d, "events")))


@query("j14_span_parents", "SELECT e.event_id AS span_id, CASE WHEN e.event_id = f.root THEN NULL ELSE f.root END AS parent_id FROM events e JOIN (SELECT user_id, arg_min(event_id, (ts, event_id)) AS root FROM events GROUP BY 1) f USING (user_id)")
def span_parents(spark, d):
    return R.spans(table(spark, d, "events")).select("span_id", "parent_id")


NESTED = """n AS (SELECT user_id AS tree, event_id AS id, ts, row_number() OVER w - 1 AS n, first_value(event_id) OVER w AS root, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT tree, id, ts, CASE WHEN n = 0 THEN NULL WHEN n % 10 = 0 THEN root ELSE before END AS parent FROM n),
t AS (SELECT tree, id, 0 AS depth, [(ts, id)] AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.tree, s.id, t.depth + 1, list_append(t.path, (s.ts, s.id)) FROM t JOIN s ON s.tree = t.tree AND s.parent = t.id)"""


@query("j14_orphan_spans", f"WITH {NESTED.split('t AS (')[0].rstrip().rstrip(',')}, k AS (SELECT * FROM s WHERE id % 9 <> 4) SELECT a.tree, a.id, b.id AS parent, a.parent IS NOT NULL AND b.id IS NULL AS orphan FROM k a LEFT JOIN k b ON a.tree = b.tree AND a.parent = b.id")
def orphan_spans(spark, d):
    """Every ninth span was lost; the spans below it become roots."""
    return R.rooted(R.nested_spans(table(spark, d, "events")).where("id % 9 <> 4").select("tree", "id", "parent"))


@query("g13_span_depths", f"WITH RECURSIVE {NESTED} SELECT id, least(depth, 8)::INT AS depth FROM t")
def span_depths(spark, d):
    return G.tree_depths(R.nested_spans(table(spark, d, "events")).select("id", "parent"), 8)


@query("g6_span_order", f"WITH RECURSIVE {NESTED} SELECT tree, id, depth::INT AS depth, row_number() OVER (PARTITION BY tree ORDER BY path) AS position FROM t")
def span_order(spark, d):
    """Parents before children, siblings by start and id."""
    return G.preorder(R.nested_spans(table(spark, d, "events")))


@query("j15_collapsed_roots", """WITH RECURSIVE r AS (SELECT event_type AS label, event_id AS id, epoch_us(ts) // 1000 AS at_ms, value AS lasts, event_id % 5 AS rich FROM events),
p AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.label = b.label AND a.id <> b.id AND abs(a.at_ms - b.at_ms) <= 200000 AND abs(a.lasts - b.lasts) <= 10),
c AS (SELECT a AS node, a AS c FROM p UNION SELECT p.b, c.c FROM c JOIN p ON p.a = c.node), g AS (SELECT node, min(c) AS c FROM c GROUP BY node)
SELECT label, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label, coalesce(c, id) ORDER BY rich DESC, at_ms, id) AS k FROM r LEFT JOIN g ON node = id) WHERE k = 1""")
def collapsed_roots(spark, d):
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 1000")
    e = table(spark, d, "events").select(F.col("event_type").alias("label"), F.col("event_id").alias("id"), ms.alias("start_ms"), F.col("value").alias("duration_ms"), (F.col("event_id") % 5).alias("richness"))
    return R.collapsed(e, 200_000, 10)


@query("a5_failure_summary", "WITH f AS (SELECT user_id AS trace_id, event_id, 'failed after ' || floor(value / 50)::INT AS m FROM events WHERE event_type = 'error'), d AS (SELECT trace_id, m, min(event_id) AS first_at FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY first_at) AS k, count(*) OVER (PARTITION BY trace_id) AS n FROM d) SELECT trace_id, max(n) AS n_distinct, string_agg(m, '; ' ORDER BY k) AS summary FROM r WHERE k <= 3 GROUP BY trace_id")
def failure_summary(spark, d):
    return R.failures(R.spans(table(spark, d, "events")), 3)


@query("j19_failed_children", "SELECT c.event_id AS span_id FROM events c JOIN (SELECT user_id, arg_min(event_id, (ts, event_id)) AS root, arg_min(event_type, (ts, event_id)) AS t FROM events GROUP BY 1) r USING (user_id) WHERE t = 'error' AND c.event_id <> root")
def failed_children(spark, d):
    s = R.spans(table(spark, d, "events"))
    bad = s.where("failed").select(F.col("span_id").alias("parent_id"))
    return s.join(bad, "parent_id", "left_semi").select("span_id")


@query("p14_trace_page", """WITH s AS (SELECT user_id::VARCHAR AS trace_id, min(ts) AS start_time, 'research' AS name, 'trace of ' || any_value(event_type ORDER BY event_id) AS display_name, 'k ' || min(event_id) AS task_preview, CASE WHEN count(*) FILTER (event_type = 'error') > 8 THEN 'error' ELSE 'success' END AS status FROM events GROUP BY user_id),
f AS (SELECT * FROM s WHERE status = 'error' AND contains(lower(trace_id || ' ' || name || ' ' || display_name || ' ' || task_preview), '1'))
SELECT trace_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY start_time DESC, trace_id LIMIT 20 OFFSET 5""")
def trace_page(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy(F.col("user_id").cast("string").alias("trace_id")).agg(F.min("ts").alias("start_time"), F.min_by("event_type", "event_id").alias("t"), F.min("event_id").alias("i"), F.count_if(F.col("event_type") == "error").alias("bad"))
    s = s.select("trace_id", "start_time", F.lit("research").alias("name"), F.concat(F.lit("trace of "), "t").alias("display_name"), F.concat(F.lit("k "), F.col("i").cast("string")).alias("task_preview"), F.when(F.col("bad") > 8, "error").otherwise("success").alias("status"))
    return R.trace_page(s, "error", " 1 ", 20, 5).select("trace_id", "total")
