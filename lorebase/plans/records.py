"""Queries on stored and shown records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import bookkeeping as B
from lorebase.operators import chunking
from lorebase.operators import planning as P
from lorebase.operators import records as R
from lorebase.plans.registry import query, table
from lorebase.plans.retrieval import CHUNKS



@query("p31_redaction", r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' key sk-abcdefgh' || doc_id WHEN 1 THEN ' Authorization: bearer.ABCDEFGH99 end' WHEN 2 THEN ' sk-short' ELSE '' END AS t FROM documents)
SELECT doc_id, md5(substr(regexp_replace(t, '(?i)\b(?:sk|pk|ghp|github_pat|Bearer)[-_A-Za-z0-9.]{8,}', '[REDACTED]', 'g'), 1, 20000)) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'api_key=[REDACTED],note=[REDACTED] x' ELSE 'note=plain' END AS fields FROM t""")
def redaction(spark, d):
    k = F.col("doc_id") % 4
    text = F.concat("text", F.when(k == 0, F.concat(F.lit(" key sk-abcdefgh"), F.col("doc_id").cast("string"))).when(k == 1, " Authorization: bearer.ABCDEFGH99 end").when(k == 2, " sk-short").otherwise(""))
    fields = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("api_key"), F.lit("abc"), F.lit("note"), F.lit("ghp_0123456789 x"))).otherwise(F.create_map(F.lit("note"), F.lit("plain")))
    shown = F.array_join(F.transform(F.map_entries(R.redacted_fields(fields)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, d, "documents").select("doc_id", F.md5(R.redacted(text)).alias("digest"), shown.alias("fields"))


@query("k3_built_points", f"""WITH {CHUNKS} SELECT (('0x' || substr(md5(chunk_id), 17, 1))::BIGINT % 8 * 1152921504606846976 + ('0x' || substr(md5(chunk_id), 18, 15))::BIGINT)::BIGINT AS id, doc_id, chunk_id FROM chunks WHERE chunk_no % 7 < 5""")
def built_points(spark, d):
    """Every seventh chunk has no vector, every seventh one of another width."""
    c = chunking.fixed_chunks(table(spark, d, "documents"))
    v = c.where("chunk_no % 7 <> 5").select("doc_id", "chunk_no", F.array_repeat(F.lit(0.5), F.when(F.col("chunk_no") % 7 == 6, 3).otherwise(4)).alias("vector"))
    return R.built_points(c, v, 4)[0].select("id", "doc_id", "chunk_id")


@query("k3_refused_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_no, CASE chunk_no % 7 WHEN 5 THEN 'missing' ELSE 'width' END AS problem FROM chunks WHERE chunk_no % 7 >= 5")
def refused_chunks(spark, d):
    c = chunking.fixed_chunks(table(spark, d, "documents"))
    v = c.where("chunk_no % 7 <> 5").select("doc_id", "chunk_no", F.array_repeat(F.lit(0.5), F.when(F.col("chunk_no") % 7 == 6, 3).otherwise(4)).alias("vector"))
    return R.built_points(c, v, 4)[1]


@query("p33_hit_view", "SELECT 'c' || event_id AS chunk_id, user_id::VARCHAR AS doc_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS content, CASE WHEN event_id % 2 = 0 THEN 'bm25' ELSE 'vector' END AS source, (event_id % 9)::INT AS page FROM events WHERE event_id % 5 <> 0")
def hit_view(spark, d):
    s = lambda c: c.cast("string")
    payload = F.map_concat(F.create_map(F.lit("doc_id"), s(F.col("user_id")), F.lit("page"), s(F.col("event_id") % 9)), F.when(F.col("event_id") % 5 != 0, F.create_map(F.lit("chunk_id"), F.concat(F.lit("c"), s(F.col("event_id"))))).otherwise(F.create_map().cast("map<string,string>")), F.when(F.col("event_id") % 3 == 1, F.create_map(F.lit("content"), F.col("event_type"))).when(F.col("event_id") % 3 == 2, F.create_map(F.lit("text"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("bm25"))).otherwise(F.create_map().cast("map<string,string>")))
    return R.hits(table(spark, d, "events").select(payload.alias("payload")))


@query("p30_public_urls", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN '' ELSE regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/]*')) || regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/+$', '') END AS url FROM pages")
def public_urls(spark, d):
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.replace("url", F.lit("://"), F.lit("://me:pass@")), F.lit("/?q=1#x"))).when(k == 1, F.concat("url", F.lit("//"))).when(k == 3, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))
    url = F.when(k == 3, F.concat(F.lit("ftp"), F.regexp_replace("url", "^[a-z]+", ""))).otherwise(url)
    return table(spark, d, "pages").select("page_id", R.public_url(url).alias("url"))


@query("x19_utc_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def utc_times(spark, d):
    return table(spark, d, "events").select("event_id", R.utc_text(F.col("ts").cast("timestamp_ntz")).alias("at"))


@query("x38_asset_keys", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE md5(doc_id::VARCHAR) || '/' || CASE WHEN doc_id % 3 = 1 THEN 'page_' || doc_id || '_x.png' ELSE 'source' END END AS key FROM documents")
def asset_keys(spark, d):
    h = F.md5(F.col("doc_id").cast("string"))
    name = F.when(F.col("doc_id") % 3 == 2, "../..").otherwise(F.concat(F.lit("../a b/.page "), F.col("doc_id").cast("string"), F.lit("/..//page "), F.col("doc_id").cast("string"), F.lit(" x.png")))
    return table(spark, d, "documents").select("doc_id", R.asset_key(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../"), h)).otherwise(h), name).alias("key"))


@query("k14_exported_spans", "SELECT trace_id, span_id, name, position, left_out FROM (SELECT user_id AS trace_id, event_id AS span_id, substr(event_type, 1, 4) AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, greatest(count(*) OVER (PARTITION BY user_id) - 40, 0) AS left_out FROM events) WHERE position <= 40")
def exported_spans(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("name"), F.col("ts").alias("start_time"))
    return R.exported_spans(s, 40, 4)


@query("p23_preferences", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'remember that I like tables of ' || event_type WHEN event_id % 3 = 1 THEN 'from now on: ' || event_type || ' answers' END AS preference FROM events")
def preferences(spark, d):
    t = F.concat(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Please remember that I like tables of "), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("from now on: "), "event_type", F.lit(" answers. Thanks"))).otherwise("nothing to say"), F.when(F.col("event_id") % 7 == 0, " my password is x").otherwise(""))
    return table(spark, d, "events").select("event_id", R.preference(t, ["remember that I like ([a-z ]+)", "from now on: ([a-z ]+)"], "(?i)password|secret|api key").alias("preference"))


@query("k35_source_labels", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'http://x,' || event_type WHEN 1 THEN event_type WHEN 2 THEN 'kb' ELSE 'task ' || user_id END AS labels FROM events")
def source_labels(spark, d):
    s = lambda u, t, o: F.struct(F.lit(u).alias("url"), t.alias("title"), F.lit(o).alias("source"))
    e, no = F.col("event_type"), F.lit("")
    sources = F.when(F.col("event_id") % 4 == 0, F.array(s("http://x", e, "kb"), s("", e, ""), s("http://x", no, ""))).when(F.col("event_id") % 4 == 1, F.array(s("", e, "kb"), s("", no, ""))).when(F.col("event_id") % 4 == 2, F.array(s("", no, "kb"), s("", no, "kb"))).otherwise(F.array(s("", no, "")))
    return table(spark, d, "events").select("event_id", F.array_join(R.source_labels(sources, F.concat(F.lit("task "), F.col("user_id").cast("string"))), ",").alias("labels"))


@query("x40_role_models", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'big' ELSE CASE WHEN event_id % 2 = 0 THEN 'a-default' ELSE 'b-default' END END AS model FROM events")
def role_models(spark, d):
    roles = spark.createDataFrame([("view", "big"), ("click", "  ")], "event_type string, role_model string")
    e = table(spark, d, "events").join(roles, "event_type", "left")
    return e.select("event_id", R.model_for(F.col("event_type"), roles, F.when(F.col("event_id") % 2 == 0, "a-default").otherwise("b-default")).alias("model"))


@query("w14_rendered_messages", "SELECT conv_id, turn, md5(substr(l, 1, (600 - before)::INT)) AS digest FROM (SELECT conv_id, turn, role || ': ' || text AS l, coalesce(sum(length(role || ': ' || text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 600")
def rendered_messages(spark, d):
    return R.rendered(table(spark, d, "conversations"), "conv_id", "turn", 600).select("conv_id", "turn", F.md5("line").alias("digest"))


@query("k20_message_sequence", "WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM conversations WHERE turn % 2 = 1), m AS (SELECT conv_id, max(sequence) AS m FROM o GROUP BY conv_id) FROM o UNION ALL SELECT c.conv_id, turn, coalesce(m, 0) + row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) FROM conversations c LEFT JOIN m ON m.conv_id = c.conv_id WHERE turn % 2 = 0")
def message_sequence(spark, d):
    """Even turns are appended to conversations that hold the odd ones."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    none = c.where("false").withColumn("sequence", F.lit(0).cast("long"))
    return B.appended(B.appended(none, c.where("turn % 2 = 1"), "conv_id", "turn"), c.where("turn % 2 = 0"), "conv_id", "turn")


@query("j6_lineage_propagation", """WITH RECURSIVE e AS (SELECT 'm' || conv_id || ':' || turn AS s, 's' || conv_id AS t FROM conversations UNION SELECT 's' || conv_id, 'a' || conv_id % 40 FROM conversations UNION SELECT 'a' || conv_id % 40, 'f' || conv_id % 7 FROM conversations),
r AS (SELECT 'm' || conv_id || ':' || turn AS id FROM conversations WHERE length(text) < 45 UNION SELECT e.t FROM r JOIN e ON e.s = r.id)
SELECT id FROM r""")
def lineage_propagation(spark, d):
    """Edited messages make stale what was derived from them, at any distance."""
    c = table(spark, d, "conversations")
    s = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    message, i = F.concat(s("m", F.col("conv_id")), F.lit(":"), F.col("turn").cast("string")), F.col("conv_id")
    e = c.select(message.alias("dep"), s("s", i).alias("task")).unionByName(c.select(s("s", i).alias("dep"), s("a", i % 40).alias("task"))).unionByName(c.select(s("a", i % 40).alias("dep"), s("f", i % 7).alias("task"))).distinct()
    return P.descendants(e, c.where("length(text) < 45").select(message.alias("task")), []).select(F.col("task").alias("id"))


@query("k15_trace_retention", "WITH t AS (SELECT user_id, max(ts) AS last FROM events WHERE event_id % 50 = user_id % 50 OR ts < TIMESTAMP '2024-01-25' GROUP BY user_id) SELECT user_id AS trace_id, count(*) AS n FROM events JOIN t USING (user_id) WHERE (event_id % 50 = user_id % 50 OR ts < TIMESTAMP '2024-01-25') AND last >= TIMESTAMP '2024-01-25' - INTERVAL 2 HOURS GROUP BY user_id")
def trace_retention(spark, d):
    """A trace goes with all its spans once its last one is too old."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp_ntz")).where("event_id % 50 = user_id % 50 OR at < TIMESTAMP_NTZ'2024-01-25'")
    return B.retained(e, "user_id", "at", F.expr("TIMESTAMP_NTZ'2024-01-25' - INTERVAL 2 HOURS")).groupBy(F.col("user_id").alias("trace_id")).agg(F.count(F.lit(1)).alias("n"))
