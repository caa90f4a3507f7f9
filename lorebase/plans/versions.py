"""Queries on tables that change: documents as a catalog, orders as jobs, conversations as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators import bookkeeping as B
from lorebase.operators import versions as V
from lorebase.plans.registry import query, table

CATALOG = """old AS (SELECT doc_id, source AS filename, n_chars // 512 AS chunk_count, CASE WHEN doc_id % 3 = 0 THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN doc_id % 3 <> 0 THEN 'stopped' END AS error, doc_id % 7 <> 0 AS enabled, '{"lang":"' || lang || '"}' AS metadata FROM documents WHERE doc_id % 4 <> 0),
new AS (SELECT doc_id, source || '.txt' AS filename, n_chars // 256 AS chunk_count, CASE WHEN doc_id % 2 = 0 THEN 'indexed' ELSE 'queued' END AS status, NULL::VARCHAR AS error, CASE WHEN doc_id % 6 = 0 THEN '{}' END AS metadata FROM documents WHERE doc_id % 5 <> 0)"""


def _old(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").where(i % 4 != 0).select("doc_id", F.col("source").alias("filename"), F.floor(F.col("n_chars") / 512).alias("chunk_count"), F.when(i % 3 == 0, "indexed").otherwise("failed").alias("status"), F.when(i % 3 != 0, "stopped").alias("error"), (i % 7 != 0).alias("enabled"), F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')).alias("metadata"))


def _new(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").where(i % 5 != 0).select("doc_id", F.concat("source", F.lit(".txt")).alias("filename"), F.floor(F.col("n_chars") / 256).alias("chunk_count"), F.when(i % 2 == 0, "indexed").otherwise("queued").alias("status"), F.lit(None).cast("string").alias("error"), F.when(i % 6 == 0, "{}").alias("metadata"))


@query("k18_upsert_documents", f"WITH {CATALOG} SELECT doc_id, CASE WHEN n.doc_id IS NULL THEN o.filename ELSE n.filename END AS filename, CASE WHEN n.doc_id IS NULL THEN o.chunk_count ELSE n.chunk_count END AS chunk_count, CASE WHEN n.doc_id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.doc_id IS NULL THEN o.error ELSE n.error END AS error, coalesce(o.enabled, TRUE) AS enabled, coalesce(n.metadata, o.metadata, '{{}}') AS metadata FROM old o FULL JOIN new n USING (doc_id)")
def upsert_documents(spark, d):
    return V.upsert_document(_old(spark, d), _new(spark, d))


@query("k18_bulk_upsert", f"WITH {CATALOG} SELECT doc_id, CASE WHEN o.doc_id IS NULL OR n.doc_id IS NOT NULL AND o.status <> 'indexed' THEN n.filename ELSE o.filename END AS filename, CASE WHEN o.doc_id IS NULL OR n.doc_id IS NOT NULL AND o.status <> 'indexed' THEN n.chunk_count ELSE o.chunk_count END AS chunk_count, CASE WHEN n.doc_id IS NULL THEN o.status ELSE 'indexed' END AS status, CASE WHEN n.doc_id IS NULL OR o.status = 'indexed' THEN o.error END AS error, coalesce(o.enabled, TRUE) AS enabled, coalesce(o.metadata, '{{}}') AS metadata FROM old o FULL JOIN new n USING (doc_id)")
def bulk_upsert(spark, d):
    return V.bulk_upsert_indexed(_old(spark, d), _new(spark, d).select("doc_id", "filename", "chunk_count"))


@query("k19_enable_and_delete", f"WITH {CATALOG} SELECT doc_id, CASE WHEN status = 'indexed' AND w.doc_id IS NOT NULL THEN w.toxic = 0 ELSE enabled END AS enabled FROM old LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) w USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def enable_and_delete(spark, d):
    labels = table(spark, d, "labels")
    wanted = labels.groupBy("doc_id").agg((F.max("toxic") == 0).alias("enabled"))
    return V.without(V.set_enabled(_old(spark, d), wanted), labels.where("quality = 0"), ["doc_id"]).select("doc_id", "enabled")


@query("k5_delete_points", "SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE NOT coalesce(label = 3, FALSE) AND vec_id % 17 <> 0 GROUP BY label")
def delete_points(spark, d):
    e = table(spark, d, "embeddings")
    left = V.without(V.without(e, e.where("label = 3"), ["label"]), e.where("vec_id % 17 = 0"), ["vec_id"])
    return left.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@query("k2_upsert_points", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END, 4) AS total FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0")
def upsert_points(spark, d):
    e = table(spark, d, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    old = e.where("vec_id % 2 = 0").select("vec_id", F.lit("old").alias("origin"), F.round(total, 4).alias("total"))
    new = e.where("vec_id % 3 = 0").select("vec_id", F.lit("new").alias("origin"), F.round(-total, 4).alias("total"))
    return V.changed(old, new, ["vec_id"], {k: F.col("new_" + k) for k in ("origin", "total")}, {k: F.col("new_" + k) for k in ("origin", "total")})


@query("k21_messages_after_edits", "SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'edited ' || md5(text) ELSE md5(text) END AS digest, turn % 3 = 2 AS deleted, CASE WHEN turn % 4 = 1 THEN 2 ELSE 1 END AS version FROM conversations")
def messages_after_edits(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("digest"), F.lit(False).alias("deleted"), F.lit(1).alias("version"))
    edits = c.where("turn % 4 = 1").select("conv_id", "turn", F.concat(F.lit("edited "), "digest").alias("digest"))
    c = V.changed(c, edits, ["conv_id", "turn"], {"digest": F.col("new_digest"), "version": F.col("version") + 1}, {})
    return V.changed(c, c.where("turn % 3 = 2").select("conv_id", "turn"), ["conv_id", "turn"], {"deleted": F.lit(True)}, {})


CONVERSATIONS = """old AS (SELECT conv_id, arg_min(substr(text, 1, 30), turn) AS title, 'active' AS status, count(*) % 3 AS version, conv_id % 10 = 4 AS deleted FROM conversations GROUP BY conv_id),
wanted AS (SELECT conv_id + CASE WHEN conv_id % 25 = 0 THEN 1000000 ELSE 0 END AS conv_id, CASE WHEN conv_id % 4 < 3 THEN conv_id % 3 END AS expected, CASE WHEN conv_id % 5 = 0 THEN '   ' ELSE '  named ' || conv_id || '  ' END AS title, CASE WHEN conv_id % 2 = 0 THEN 'archived' END AS status FROM old WHERE conv_id % 3 <> 0),
j AS (SELECT w.*, o.version, CASE WHEN o.version IS NULL OR o.deleted THEN 'not_found' WHEN w.expected <> o.version THEN 'version_conflict' END AS problem FROM wanted w LEFT JOIN old o USING (conv_id))"""


def _conversations(spark, d):
    i = F.col("conv_id")
    old = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 30), "turn").alias("title"), F.lit("active").alias("status"), (F.count(F.lit(1)) % 3).alias("version")).withColumn("deleted", i % 10 == 4)
    w = old.where(i % 3 != 0).select((i + F.when(i % 25 == 0, 1000000).otherwise(0)).alias("conv_id"), F.when(i % 4 < 3, i % 3).alias("expected"), F.when(i % 5 == 0, "   ").otherwise(F.concat(F.lit("  named "), i.cast("string"), F.lit("  "))).alias("title"), F.when(i % 2 == 0, "archived").alias("status"))
    return old, w


@query("k22_conversation_updates", f"WITH {CONVERSATIONS} SELECT conv_id, CASE WHEN g.conv_id IS NOT NULL AND trim(g.title) <> '' THEN trim(g.title) ELSE o.title END AS title, coalesce(g.status, o.status) AS status, o.version + CASE WHEN g.conv_id IS NULL THEN 0 ELSE 1 END AS version, deleted FROM old o LEFT JOIN (SELECT * FROM j WHERE problem IS NULL) g USING (conv_id)")
def conversation_updates(spark, d):
    return V.update_conversations(*_conversations(spark, d))[0]


@query("k22_update_conflicts", f"WITH {CONVERSATIONS} SELECT conv_id, problem FROM j WHERE problem IS NOT NULL")
def update_conflicts(spark, d):
    return V.update_conversations(*_conversations(spark, d))[1]


@query("k22_deleted_conversations", f"WITH {CONVERSATIONS} SELECT conv_id, CASE WHEN NOT deleted AND conv_id % 4 = 0 THEN 'deleted' ELSE status END AS status, version + CASE WHEN NOT deleted AND conv_id % 4 = 0 THEN 1 ELSE 0 END AS version, deleted OR conv_id % 4 = 0 AS deleted FROM old")
def deleted_conversations(spark, d):
    old = _conversations(spark, d)[0]
    return V.delete_conversations(old, old.where("conv_id % 4 = 0").select("conv_id")).drop("title")


SUMMARIES = """old AS (SELECT conv_id || ':' || turn AS summary_id, conv_id, turn AS to_turn, CASE WHEN turn % 3 = 0 THEN 'invalidated' ELSE 'active' END AS status, turn % 4 + 1 AS version FROM conversations WHERE role = 'assistant'),
new AS (SELECT 'new:' || conv_id AS summary_id, conv_id, max(turn) AS to_turn FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id)"""


def _summaries(spark, d):
    c, key = table(spark, d, "conversations"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    old = c.where("role = 'assistant'").select(key.alias("summary_id"), "conv_id", F.col("turn").alias("to_turn"), F.when(F.col("turn") % 3 == 0, "invalidated").otherwise("active").alias("status"), (F.col("turn") % 4 + 1).alias("version"))
    return old, c.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.max("turn").alias("to_turn")).withColumn("summary_id", F.concat(F.lit("new:"), F.col("conv_id").cast("string")))


@query("k23_replaced_summaries", f"WITH {SUMMARIES} SELECT summary_id, conv_id, to_turn, CASE WHEN status = 'active' AND conv_id IN (SELECT conv_id FROM new) THEN 'superseded' ELSE status END AS status, version FROM old UNION ALL SELECT summary_id, conv_id, to_turn, 'active', 1 FROM new")
def replaced_summaries(spark, d):
    return V.replace_summaries(*_summaries(spark, d))


@query("k24_lineage_edges", """WITH old AS (SELECT DISTINCT 'message' AS source_type, conv_id || ':' || turn AS source_id, 'summary' AS derived_type, 'new:' || conv_id AS derived_id, 'summarized_from' AS relation FROM conversations WHERE turn % 2 = 0),
new AS (SELECT 'message' AS source_type, conv_id || ':' || turn AS source_id, 'summary' AS derived_type, 'new:' || conv_id AS derived_id, 'summarized_from' AS relation FROM conversations)
SELECT * FROM old UNION SELECT * FROM new""")
def lineage_edges(spark, d):
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    e = table(spark, d, "conversations").select("turn", F.lit("message").alias("source_type"), key.alias("source_id"), F.lit("summary").alias("derived_type"), F.concat(F.lit("new:"), F.col("conv_id").cast("string")).alias("derived_id"), F.lit("summarized_from").alias("relation"))
    new = e.drop("turn")
    return V.add_if_absent(e.where("turn % 2 = 0").drop("turn").distinct(), new, new.columns)


def _snapshots(spark, d):
    c = table(spark, d, "conversations")
    g = c.groupBy(F.col("conv_id").alias("run_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])).alias("items"), F.min("turn").alias("at"))
    bundles = g.select("run_id", F.md5(F.array_join("items", ",")).alias("fingerprint"), "items")
    return bundles.where("run_id % 3 = 0").withColumn("fingerprint", F.lit("kept")), bundles


SNAPSHOTS = """b AS (SELECT conv_id AS run_id, list(turn || ':' || role ORDER BY turn, role) AS items FROM conversations GROUP BY conv_id),
snap AS (SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'kept' ELSE md5(array_to_string(items, ',')) END AS fingerprint, items FROM b)"""


@query("k25_snapshots", f"WITH {SNAPSHOTS} SELECT run_id, fingerprint, len(items)::BIGINT AS n FROM snap")
def snapshots(spark, d):
    return V.create_snapshots(*_snapshots(spark, d)).select("run_id", "fingerprint", F.size("items").cast("long").alias("n"))


@query("k25_snapshot_items", f"WITH {SNAPSHOTS} SELECT run_id, generate_subscripts(items, 1)::INT AS rank, unnest(items) AS item FROM snap")
def snapshot_items(spark, d):
    return V.snapshot_items(V.create_snapshots(*_snapshots(spark, d)))


@query("j8_snapshots_with_items", "SELECT conv_id AS run_id, coalesce(string_agg(turn || ':' || role, ',' ORDER BY turn, role) FILTER (conv_id % 4 <> 1), '') AS items, count(*) FILTER (conv_id % 4 <> 1) AS n FROM conversations GROUP BY conv_id")
def snapshots_with_items(spark, d):
    s = _snapshots(spark, d)[1]
    return V.snapshots_with_items(s, V.snapshot_items(s).where("run_id % 4 <> 1"))


@query("k26_snapshot_retention", "SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAYS GROUP BY user_id")
def snapshot_retention(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    return V.unexpired(e, "at", F.expr("TIMESTAMP_NTZ'2024-01-30'"), 14).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("k27_artifacts", """SELECT doc_id, CASE WHEN trim(title) = '' THEN 'section' ELSE substr(trim(title), 1, 300) END AS title, md5(substr(trim(text), 1, 100000)) AS digest, len(ids[1:100])::BIGINT AS n_sources, doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AS enabled
FROM (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN '  ' ELSE ' ' || split_part(text, chr(10), 1) || ' ' END AS title, range(0, n_chars // 20 + 1) AS ids FROM documents)""")
def artifacts(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.lit("section").alias("artifact_type"), F.when(F.col("doc_id") % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), F.split("text", "\n")[0], F.lit(" "))).alias("title"), F.col("text").alias("content"), F.sequence(F.lit(0), F.floor(F.col("n_chars") / 20)).alias("source_ids"), F.lit(True).alias("enabled"))
    off = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().join(docs, "doc_id", "left_semi").withColumn("enabled", F.lit(False))
    a = V.changed(V.create_artifacts(rows), off, ["doc_id"], {"enabled": F.col("new_enabled")}, {})
    return a.select("doc_id", "title", F.md5("content").alias("digest"), F.size("source_ids").cast("long").alias("n_sources"), "enabled")


@query("k28_memories", """WITH e AS (SELECT event_id AS memory_id, user_id, event_type AS category, ' ' || (event_id % 40) || ' said ' AS content, value / 50 - 0.2 AS confidence, CASE WHEN event_id % 4 = 0 THEN 'forgotten' ELSE 'active' END AS status FROM events),
old AS (SELECT memory_id, user_id, category, trim(content) AS content, greatest(0.0, least(1.0, confidence)) AS confidence, status FROM e WHERE memory_id % 2 = 0),
new AS (SELECT user_id, category, trim(content) AS content, min(memory_id) AS memory_id FROM e WHERE memory_id % 2 = 1 GROUP BY ALL)
SELECT memory_id, user_id, category, content, round(confidence, 6) AS confidence, status FROM old UNION ALL SELECT n.memory_id, n.user_id, n.category, n.content, round(greatest(0.0, least(1.0, e.confidence)), 6), 'active' FROM new n JOIN e USING (memory_id) WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = n.user_id AND o.category = n.category AND o.content = n.content AND o.status = 'active')""")
def memories(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(i.alias("memory_id"), "user_id", F.col("event_type").alias("category"), F.concat(F.lit(" "), (i % 40).cast("string"), F.lit(" said ")).alias("content"), (F.col("value") / 50 - 0.2).alias("confidence"), F.when(i % 4 == 0, "forgotten").otherwise("active").alias("status"))
    old = e.where("memory_id % 2 = 0").withColumn("content", F.trim("content")).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    return V.add_memories(old, e.where("memory_id % 2 = 1")).withColumn("confidence", F.round("confidence", 6))


JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status, 10.0::DOUBLE AS progress, o_orderpriority AS error, 1.5::DOUBLE AS seconds, FALSE AS cancel FROM orders),
u AS (SELECT job_id, o_totalprice / 1000 - 50 AS progress, CASE WHEN job_id % 3 = 0 THEN repeat('ab', 1500) END AS error, o_totalprice / 7 AS seconds, CASE WHEN job_id % 5 = 0 THEN 'failed' END AS status, job_id % 2 = 0 AS cancel FROM jobs JOIN orders ON o_orderkey = job_id WHERE job_id % 4 <> 3)"""


def _jobs(spark, d):
    o, i = table(spark, d, "orders"), F.col("job_id")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"), F.lit(10.0).alias("progress"), F.col("o_orderpriority").alias("error"), F.lit(1.5).alias("seconds"), F.lit(False).alias("cancel"))
    u = o.withColumnRenamed("o_orderkey", "job_id").where(i % 4 != 3).select("job_id", (F.col("o_totalprice") / 1000 - 50).alias("progress"), F.when(i % 3 == 0, "ab" * 1500).alias("error"), (F.col("o_totalprice") / 7).alias("seconds"), F.when(i % 5 == 0, "failed").alias("status"), (i % 2 == 0).alias("cancel"))
    return jobs, u


@query("k29_job_updates", f"WITH {JOBS} SELECT job_id, coalesce(u.status, jobs.status) AS status, round(CASE WHEN u.progress IS NULL THEN jobs.progress ELSE least(100.0, greatest(0.0, u.progress)) END, 6) AS progress, length(coalesce(substr(u.error, 1, 2000), jobs.error))::BIGINT AS error_chars, round(coalesce(u.seconds, jobs.seconds), 2) AS seconds, coalesce(u.cancel, FALSE) AND jobs.status NOT IN ('completed', 'failed', 'cancelled') AS cancel FROM jobs LEFT JOIN u USING (job_id)")
def job_updates(spark, d):
    return V.update_jobs(*_jobs(spark, d)).select("job_id", "status", F.round("progress", 6).alias("progress"), F.length("error").cast("long").alias("error_chars"), F.round("seconds", 2).alias("seconds"), "cancel")


@query("s26_recovered_jobs", f"WITH {JOBS} SELECT job_id, 'queued' AS status FROM jobs WHERE status IN ('queued', 'running')")
def recovered_jobs(spark, d):
    return V.recover_jobs(_jobs(spark, d)[0]).select("job_id", "status")


@query("p13_catalog_list", f"WITH {CATALOG} SELECT doc_id, filename, chunk_count, row_number() OVER (PARTITION BY filename ORDER BY chunk_count DESC, doc_id) AS position FROM old WHERE status = 'indexed'")
def catalog_list(spark, d):
    w = Window.partitionBy("filename").orderBy(F.desc("chunk_count"), "doc_id")
    return _old(spark, d).where("status = 'indexed'").select("doc_id", "filename", "chunk_count", F.row_number().over(w).cast("long").alias("position"))


@query("t13_history_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 5 = 0 THEN '' ELSE '2024-01-' || lpad((turn % 28 + 1)::VARCHAR, 2, '0') END DESC, turn) AS position FROM conversations")
def history_order(spark, d):
    at = F.when(F.col("turn") % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0")))
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.coalesce(at, F.lit(""))), "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("position"))


@query("g10_cascade_delete", """WITH gone AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT 'messages' AS name, count(*) AS n FROM conversations WHERE conv_id NOT IN (FROM gone) UNION ALL SELECT 'artifacts', count(*) FROM documents WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'memories', count(*) FROM events WHERE event_id NOT IN (FROM gone)
UNION ALL SELECT 'jobs', count(*) FROM gone""")
def cascade_delete(spark, d):
    """Rows left in each table, and a deletion job for each conversation that goes."""
    c = table(spark, d, "conversations")
    gone = c.where("role = 'system'").select("conv_id").distinct()
    tables = {"messages": c.select("conv_id"), "artifacts": table(spark, d, "documents").select(F.col("doc_id").alias("conv_id")), "memories": table(spark, d, "events").select(F.col("event_id").alias("conv_id"))}
    left = V.cascade(tables, gone, "conv_id") | {"jobs": gone}
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in left.items()])


@query("k13_episodes", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAYS) WHERE r <= 10")
def episodes(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    return B.prune(e, ["user_id"], "at", "event_id", F.expr("TIMESTAMP_NTZ'2024-01-30' - INTERVAL 20 DAYS"), 10).select("event_id", "user_id")
