"""Queries on results: events and documents stand for runs and their outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import memory as M
from lorebase.operators import outcomes as O
from lorebase.plans.memory import _likes
from lorebase.plans.registry import query, table



@query("p34_cache_reuse", """WITH r AS (SELECT event_id AS i, CASE event_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'a [x]([y](z))' WHEN 2 THEN 'u?ws_call_id=3' ELSE 'text [' || (event_id % 3) || ']' END AS o, event_id % 7 <> 3 AS has, event_id % 2 = 0 AS needs FROM events)
SELECT i AS event_id, CASE WHEN trim(o) = '' THEN 'empty' WHEN contains(o, '](') AND contains(o, ']([') OR contains(o, 'ws_call_id=') OR has AND i % 31 = 0 THEN 'refresh' WHEN needs AND (NOT has OR NOT regexp_matches(o, '\\[[1-9]\\d*\\]')) THEN 'unsourced' WHEN i % 10 = 4 OR i % 12 = 5 OR i % 14 = 6 OR i % 15 = 8 THEN 'degraded' WHEN i % 11 = 7 THEN 'fallback_plan' WHEN i % 13 = 8 THEN 'fingerprint' END AS problem FROM r""")
def cache_reuse(spark, d):
    k = F.col("event_id") % 9
    o = F.when(k == 0, " ").when(k == 1, "a [x]([y](z))").when(k == 2, "u?ws_call_id=3").otherwise(F.concat(F.lit("text ["), (F.col("event_id") % 3).cast("string"), F.lit("]")))
    url = F.when(F.col("event_id") % 31 == 0, "http://x?ws_call_id=1").otherwise("http://x")
    sources = F.when(F.col("event_id") % 7 != 3, F.array(url)).otherwise(F.array().cast("array<string>"))
    problem = O.reuse_problem(o, sources, F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 10 == 4, " Degraded").otherwise("success"), F.when(F.col("event_id") % 12 == 5, 2).otherwise(0), F.when(F.col("event_id") % 14 == 6, "evaluation_failed").otherwise("evaluated"), F.when(F.col("event_id") % 15 == 8, "invalid").otherwise("valid"), F.when(F.col("event_id") % 11 == 7, "fallback").otherwise("ok"), F.col("event_id") % 13 != 8)
    return table(spark, d, "events").select("event_id", problem.alias("problem"))


@query("p35_remembered_runs", "SELECT event_id, e AS episode, e AND event_id % 3 = 0 AND coalesce(q >= 7, FALSE) AS fact, round(CASE WHEN q > 0 THEN greatest(0.0, least(1.0, q / 10)) ELSE 0.5 END, 6)::DOUBLE AS confidence FROM (SELECT event_id, event_type <> 'error' AND event_id % 6 <> 1 AND event_id % 10 <> 2 AS e, CASE WHEN event_id % 8 <> 0 THEN value - 2 END AS q FROM events)")
def remembered_runs(spark, d):
    e, fact, confidence = O.remembered(F.col("event_type") != "error", F.when(F.col("event_id") % 6 == 1, "DEGRADED ").otherwise("success"), F.when(F.col("event_id") % 10 == 2, "model_only").otherwise("grounded"), F.when(F.col("event_id") % 8 != 0, F.col("value") - 2), F.col("event_id") % 3 == 0)
    return table(spark, d, "events").select("event_id", e.alias("episode"), fact.alias("fact"), F.round(confidence, 6).alias("confidence"))


@query("p36_reusable_indexes", "SELECT o_orderkey AS doc_id, n AS chunk_count FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 1) AS v, count(*) FILTER (l_tax < 0.08) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND n = v AND n = b")
def reusable_indexes(spark, d):
    line = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    n = line.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    catalog = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("indexed").alias("status")).join(n, "doc_id")
    return O.reusable_indexes(catalog, line.where("l_quantity > 1"), line.where("l_tax < 0.08")).select("doc_id", "chunk_count")


@query("p39_fallback_outcomes", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_type = 'error' THEN 'degraded' ELSE 'retrieval_only' END AS outcome FROM events")
def fallback_outcomes(spark, d):
    return table(spark, d, "events").select("event_id", O.fallback_outcome(F.when(F.col("event_type") == "error", "failed"), F.col("event_id") % 5).alias("outcome"))


@query("p42_subtask_views", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'meta' WHEN event_id % 3 = 0 THEN 'data' ELSE 'success' END AS outcome, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'unknown' END AS model FROM events")
def subtask_views(spark, d):
    none = F.create_map().cast("map<string,string>")
    meta = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("outcome"), F.lit("meta"))).otherwise(none)
    data = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("outcome"), F.lit("data"), F.lit("model"), F.col("event_type"))).otherwise(none)
    return table(spark, d, "events").select("event_id", *O.subtask_view(meta, data, {"outcome": "success", "model": "unknown"}))


@query("p41_public_records", "SELECT doc_id, coalesce(lang, '') AS lang, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'source=' || source END AS metadata FROM documents")
def public_records(spark, d):
    """Missing metadata is an empty map."""
    m = F.coalesce(F.when(F.col("doc_id") % 4 != 0, F.create_map(F.lit("source"), F.col("source"))), F.create_map().cast("map<string,string>"))
    return table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


@query("a31_distinct_ids", "WITH r AS (SELECT l_suppkey AS supp, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'p' || (l_partkey % 300) END AS id FROM lineitem), f AS (SELECT supp, id, min(l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey) AS first FROM r WHERE id <> '' GROUP BY ALL) SELECT supp, string_agg(id, ',' ORDER BY first) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY supp ORDER BY first) AS k FROM f) WHERE k <= 100 GROUP BY supp")
def distinct_ids(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))).alias("x"))
    ids = F.transform("x", lambda e: F.when(e["l_partkey"] % 9 == 0, "").otherwise(F.concat(F.lit("p"), (e["l_partkey"] % 300).cast("string"))))
    return g.select("supp", F.array_join(O.distinct_ids(ids), ",").alias("ids"))


@query("w15_headed_sections", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT *, n % 6 = 2 AND length(trim(line, ' ' || chr(9) || chr(13))) BETWEEN 2 AND 190 AND NOT regexp_matches(line, '[\\r\\x{0085}\\x{2028}\\x{2029}]') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM h),
t AS (SELECT doc_id, section, max(trim(line)) FILTER (head) AS title, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), ''), '^\\s+|\\s+$', '', 'g') AS content, bool_or(head) AS headed FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS k FROM t WHERE section > 0 AND content <> '')
SELECT doc_id AS report_id, k::INT AS section, md5(title) AS title, md5(content) AS content FROM r WHERE k < 12 UNION ALL SELECT doc_id, 0, md5(''), md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE head)""")
def headed_sections(spark, d):
    """Every sixth line from the second on becomes a heading, if it may be one."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 6 == 1) & F.length(F.trim(F.translate(x, "\t\r", "  "))).between(2, 190) & ~x.rlike("[\\r\\x{0085}\\x{2028}\\x{2029}]"), F.concat(F.lit("## "), F.trim(x))).otherwise(x))
    return O.report_sections(table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.array_join(line, "\n").alias("report"))).select("report_id", "section", F.md5("title").alias("title"), F.md5("content").alias("content"))


@query("p21_grounded_artifacts", f"""WITH o AS (SELECT event_id, user_id, event_type AS title, CASE WHEN event_id % 11 = 0 THEN '  ' ELSE props || CASE WHEN event_id % 6 = 0 THEN ' 最新' WHEN event_id % 6 = 1 THEN ' 政策' ELSE '' END END AS content FROM events WHERE event_type <> 'error' AND event_id % 4 <> 3 AND event_id % 5 > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM o WHERE trim(content) <> '')
SELECT user_id AS run_id, rank, title, trim(content) AS content, CASE WHEN {_likes("lower(title || chr(10) || content)", M.VOLATILE)} THEN 'volatile' WHEN {_likes("lower(title || chr(10) || content)", M.TIME_SENSITIVE)} THEN 'time_sensitive' ELSE 'stable' END AS freshness FROM g WHERE rank <= 20""")
def grounded_artifacts(spark, d):
    more = F.when(F.col("event_id") % 6 == 0, " 最新").when(F.col("event_id") % 6 == 1, " 政策").otherwise("")
    o = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 11 == 0, "  ").otherwise(F.concat("props", more)).alias("content"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_id") % 4 == 3, "model_only").when(F.col("event_id") % 4 == 2, "not_required").otherwise("grounded").alias("grounding"), (F.col("event_id") % 5).alias("n_sources"))
    return O.artifacts(o, F.expr("TIMESTAMP_NTZ'2024-01-20'")).drop("expires_at")


@query("k37_root_status", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_type = 'error' OR event_id % 9 = 0 THEN 'error' WHEN event_id % 4 = 0 THEN 'warning' ELSE 'success' END AS status FROM events")
def root_status(spark, d):
    outcome = F.when(F.col("event_id") % 7 == 0, "cancelled").when(F.col("event_id") % 4 == 0, "degraded").otherwise("success")
    return table(spark, d, "events").select("event_id", O.root_status(outcome, F.col("event_type") != "error", F.when(F.col("event_id") % 9 == 0, "late")).alias("status"))


@query("a27_guardrails", """WITH s AS (SELECT doc_id, n_chars, n_chars % 10 + 0.5 AS v, doc_id % 3 = 0 AND length(trim(text)) < greatest(1600, floor(4000 * 0.75)) AS short, doc_id % 2 = 0 AS src, doc_id % 5 < 2 AS mark, doc_id % 5 = 1 AS bad FROM documents),
r AS (SELECT *, src AND NOT mark AS missing, NOT src AND mark AS unbacked FROM s)
SELECT doc_id, least(v, CASE WHEN short THEN 5.0 END)::DOUBLE AS depth, least(v, CASE WHEN bad OR unbacked THEN 5.0 END)::DOUBLE AS accuracy, least(v, CASE WHEN missing THEN 2.0 END, CASE WHEN bad OR unbacked THEN 0.0 END)::DOUBLE AS citations, least(v, CASE WHEN short THEN 5.5 END, CASE WHEN missing THEN 6.0 END, CASE WHEN bad OR unbacked THEN 5.0 END)::DOUBLE AS overall,
 array_to_string(list_filter([CASE WHEN short THEN 'insufficient_depth' END, CASE WHEN missing THEN 'missing_citations' END, CASE WHEN bad THEN 'invalid_citations' END, CASE WHEN unbacked THEN 'unbacked_citations' END], lambda x: x IS NOT NULL), ',') AS broken FROM r""")
def guardrails(spark, d):
    i, v = F.col("doc_id"), F.col("n_chars") % 10 + F.lit(0.5)
    scores, broken = O.guardrails({k: v for k in ("depth", "accuracy", "citations", "overall")}, i % 3 == 0, F.length(F.trim("text")), F.lit(4000), i % 5 < 2, i % 2 == 0, i % 5 == 1)
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in scores.items()], F.array_join(broken, ",").alias("broken"))


@query("x27_flat_usage", "SELECT event_id, 'completion_tokens=' || (event_id % 50) || CASE WHEN event_id % 3 = 0 THEN ',prompt_cache_hit_tokens=' || (event_id % 20 + 1) ELSE '' END || ',prompt_tokens=' || (event_id % 90) || CASE WHEN event_id % 3 = 0 THEN ',prompt_tokens_details_cached_tokens=' || (event_id % 20 + 1) ELSE '' END AS usage FROM events")
def flat_usage(spark, d):
    f = lambda c: c.cast("double")
    counts = F.create_map(F.lit("prompt_tokens"), f(F.col("event_id") % 90) + 0.4, F.lit("completion_tokens"), f(F.col("event_id") % 50))
    details = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("cached_tokens"), f(F.col("event_id") % 20 + 1)))
    usage = O.flat_usage(F.struct(counts.alias("counts"), details.alias("prompt_tokens_details")), ["prompt_tokens_details"])
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(usage), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias("usage"))


@query("w13_interleaved_fields", "SELECT conv_id, turn, md5(substr(t, 1, greatest(0, 500 - before)::INT)) AS digest FROM (SELECT conv_id, turn, substr(text, 1, 200) AS t, coalesce(sum(length(substr(text, 1, 200))) OVER (PARTITION BY conv_id ORDER BY turn // 3, turn % 3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)")
def interleaved_fields(spark, d):
    """Items of three fields in turn, each at most two fifths of the cap."""
    c = table(spark, d, "conversations").withColumn("item", F.floor(F.col("turn") / 3)).withColumn("field", F.col("turn") % 3)
    return O.interleaved(c, "conv_id", ["item", "field"], "text", 500).select("conv_id", "turn", F.md5("taken").alias("digest"))


@query("u1_hit_union", "SELECT search, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT 0 AS search, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id FROM documents WHERE n_chars > 500 UNION ALL SELECT 2, doc_id FROM labels) GROUP BY search")
def hit_union(spark, d):
    docs = table(spark, d, "documents")
    hits = O.union_hits(docs.where("lang = 'en'").select("doc_id", "source"), docs.where("n_chars > 500").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"))
    return hits.groupBy("search").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("u7_merged_summaries", "WITH c AS (SELECT conv_id, count(*) AS n, max(turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND n % 2 = 0 THEN 'model ' || n ELSE 'plain ' || t END AS goal, CASE WHEN conv_id % 3 = 0 THEN 'decided' ELSE 'open' END AS state FROM c")
def merged_summaries(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("t"))
    plain = c.select("conv_id", F.concat(F.lit("plain "), F.col("t").cast("string")).alias("goal"), F.lit("open").alias("state"))
    model = c.where("conv_id % 5 <> 1 OR conv_id % 3 = 0").select("conv_id", (F.col("conv_id") % 3 == 0).alias("accepted"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("model "), F.col("n").cast("string"))).otherwise(" ").alias("goal"), F.lit("decided").alias("state"))
    return O.merged_summary(model, plain, "conv_id", ["goal", "state"])
