"""Queries on the context of requests: conversations ask, documents and events are remembered."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.operators import context as X
from lorebase.operators import conversations as C
from lorebase.plans.registry import query, table

TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-zA-Z0-9_+#.-]{{2,}}'))"
REL = "CASE WHEN len({q}) = 0 OR len({c}) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, len(list_intersect({q}, {c}))::DOUBLE / len({q}) * 0.75::DOUBLE + len(list_intersect({q}, {c}))::DOUBLE / least(len({c}), len({q}) * 4) * 0.25::DOUBLE) END"

# a conversation's last question; its messages; an artifact (a document) and a memory (an event) of its own
CANDIDATES = f"""q AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
m AS (SELECT conv_id, 'message' AS kind, conv_id || ':' || turn AS source_id, CASE WHEN role = 'user' THEN 'question' ELSE 'answer' END AS title, text AS content, FALSE AS pinned, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS recency, NULL::TIMESTAMP AS expires_at, NULL::VARCHAR AS grounding FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
a AS (SELECT q.conv_id, 'artifact' AS kind, doc_id::VARCHAR AS source_id, source AS title, text AS content, FALSE AS pinned, NULL::BIGINT AS recency, TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) AS expires_at, CASE WHEN doc_id % 5 = 0 THEN 'model_only' ELSE 'grounded' END AS grounding FROM documents JOIN q ON q.conv_id = doc_id),
e AS (SELECT q.conv_id, 'memory' AS kind, event_id::VARCHAR AS source_id, event_type AS title, event_type || ' ' || props AS content, event_id % 7 = 0 AS pinned, NULL::BIGINT AS recency, CASE WHEN event_id % 3 = 0 THEN ts::TIMESTAMP END AS expires_at, NULL::VARCHAR AS grounding FROM events JOIN q ON q.conv_id = event_id),
cand AS (SELECT * FROM m UNION ALL SELECT * FROM a UNION ALL SELECT * FROM e)"""


def _asked(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))


def _candidates(spark, d):
    q = _asked(spark, d).select("conv_id")
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) - 1
    m = c.select("conv_id", F.lit("message").alias("kind"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source_id"), F.when(F.col("role") == "user", "question").otherwise("answer").alias("title"), F.col("text").alias("content"), F.lit(False).alias("pinned"), newest.cast("long").alias("recency"))
    a = table(spark, d, "documents").join(q, F.col("doc_id") == q["conv_id"])
    a = a.select("conv_id", F.lit("artifact").alias("kind"), F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("title"), F.col("text").alias("content"), F.lit(False).alias("pinned"), F.expr("TIMESTAMP_NTZ'2024-01-01' + make_interval(0, 0, 0, int(doc_id % 60))").alias("expires_at"), F.when(F.col("doc_id") % 5 == 0, "model_only").otherwise("grounded").alias("grounding"))
    e = table(spark, d, "events").join(q, F.col("event_id") == q["conv_id"])
    e = e.select("conv_id", F.lit("memory").alias("kind"), F.col("event_id").cast("string").alias("source_id"), F.col("event_type").alias("title"), F.concat_ws(" ", "event_type", "props").alias("content"), (F.col("event_id") % 7 == 0).alias("pinned"), F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp_ntz")).alias("expires_at"))
    return X.candidates(m, a, e)


@query("p6_context_candidates", f"WITH {CANDIDATES} SELECT conv_id, kind, source_id, title, pinned, recency, length(content)::BIGINT AS chars, md5(content) AS digest, expires_at::VARCHAR AS expires_at, grounding FROM cand")
def context_candidates(spark, d):
    c = _candidates(spark, d)
    return c.select("conv_id", "kind", "source_id", "title", "pinned", "recency", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"), F.col("expires_at").cast("string").alias("expires_at"), "grounding")


POLICY = f"""{CANDIDATES}, r AS (SELECT c.*, conv_id % 3 = 0 AS manual, {REL.format(q='qt', c='ct')} AS rel, (conv_id + length(content)) % 13 = 0 AS excluded, length(content) % 4 = 0 AS selected FROM (SELECT cand.*, {TERMS.format('query')} AS qt, {TERMS.format('substr(content, 1, 20000)')} AS ct FROM cand JOIN q USING (conv_id)) c),
p AS (SELECT *, CASE WHEN excluded THEN 'user_excluded' WHEN manual AND NOT selected THEN 'not_selected' WHEN expires_at <= TIMESTAMP '2024-01-20' THEN 'expired' WHEN kind = 'artifact' AND grounding = 'model_only' THEN 'model_only'
  WHEN NOT manual AND NOT pinned AND NOT selected AND NOT coalesce(recency = 0, FALSE) AND rel < 0.12::DOUBLE THEN 'low_relevance' END AS reason FROM r)"""


def _policy(spark, d):
    c = _candidates(spark, d).join(_asked(spark, d), "conv_id").withColumn("manual", F.col("conv_id") % 3 == 0)
    rel = X.relevance(F.col("query"), F.col("content"))
    kept = F.col("pinned") | F.coalesce(F.col("recency") == 0, F.lit(False))
    mode = F.when(F.col("manual"), "manual").otherwise("auto")
    excluded, selected = (F.col("conv_id") + F.length("content")) % 13 == 0, F.length("content") % 4 == 0
    now = F.expr("TIMESTAMP_NTZ'2024-01-20'")
    return c.withColumn("rel", rel).withColumn("reason", X.exclusion_reason(mode, excluded, selected, F.col("expires_at"), now, F.col("kind"), F.col("grounding"), F.col("rel"), kept))


@query("p5_context_policy", f"WITH {POLICY} SELECT conv_id, kind, source_id, round(rel, 6) AS relevance, reason FROM p")
def context_policy(spark, d):
    return _policy(spark, d).select("conv_id", "kind", "source_id", F.round("rel", 6).alias("relevance"), "reason")


@query("a23_bundle_fingerprint", f"""WITH {POLICY}, i AS (SELECT conv_id, query, kind || ':' || source_id AS id, '{{"content":"' || sha256(content) || '","freshness":"current","id":"' || kind || ':' || source_id || '","selection_reason":"relevant","title":"' || title || '"}}' AS j FROM p JOIN q USING (conv_id) WHERE reason IS NULL)
SELECT conv_id, sha256('{{"embedding":"lexical-v1","items":[' || string_agg(j, ',' ORDER BY id) || '],"policy":"context-policy-v1","query":' || to_json(trim(any_value(query)))::VARCHAR || '}}') AS fingerprint FROM i GROUP BY conv_id""")
def bundle_fingerprint(spark, d):
    items = _policy(spark, d).where("reason IS NULL").select("conv_id", "query", F.concat_ws(":", "kind", "source_id").alias("id"), "title", "content", F.lit("relevant").alias("reason"), F.lit("current").alias("freshness"))
    return X.fingerprint(items, "conv_id", "query", "id")


@query("p9_active_conversations", "SELECT conv_id, updated, n, row_number() OVER (PARTITION BY conv_id % 50 ORDER BY updated DESC, created DESC, conv_id) AS position FROM (SELECT conv_id, max(turn) AS updated, min(turn) AS created, count(*) AS n FROM conversations GROUP BY conv_id) WHERE conv_id % 9 <> 0")
def active_conversations(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"), F.min("turn").alias("created"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.col("conv_id") % 50).orderBy(F.desc("updated"), F.desc("created"), "conv_id")
    return C.active(c, F.col("conv_id") % 9 == 0).select("conv_id", "updated", "n", F.row_number().over(w).cast("long").alias("position"))


@query("p10_active_summary", "WITH s AS (SELECT conv_id, turn AS to_turn, length(text) % 5 AS version, CASE WHEN length(text) % 3 = 0 THEN 'superseded' ELSE 'active' END AS status, md5(text) AS digest FROM conversations) SELECT conv_id, arg_max(to_turn, (to_turn, version)) AS to_turn, arg_max(version, (to_turn, version)) AS version, arg_max(digest, (to_turn, version)) AS digest FROM s WHERE status = 'active' GROUP BY conv_id")
def active_summary(spark, d):
    s = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("to_turn"), (F.length("text") % 5).cast("long").alias("version"), F.when(F.length("text") % 3 == 0, "superseded").otherwise("active").alias("status"), F.md5("text").alias("digest"))
    return C.active_summary(s)


@query("p11_artifact_search", f"""WITH d AS (SELECT doc_id, source, text, n_chars, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) END AS expires_at FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 AND doc_id % 5 <> 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM d) WHERE r <= 250 AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20')),
s AS (SELECT source, doc_id, {REL.format(q='qt', c='ct')} AS relevance, r FROM (SELECT *, {TERMS.format("'the data of ' || source || ' is in there'")} AS qt, {TERMS.format("substr(source || chr(10) || text, 1, 20000)")} AS ct FROM n))
SELECT source, doc_id, round(relevance, 6) AS relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, r) AS rank FROM s) WHERE rank <= 8""")
def artifact_search(spark, d):
    """Per source: enabled and grounded artifacts, newest (here longest) 250, unexpired, the 8 most relevant."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").where((F.coalesce("toxic", F.lit(0)) == 0) & (F.col("doc_id") % 5 != 0))
    docs = docs.withColumn("expires_at", F.expr("CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP_NTZ'2024-01-01' + make_interval(0, 0, 0, int(doc_id % 60)) END"))
    asked = F.concat(F.lit("the data of "), F.col("source"), F.lit(" is in there"))
    score = X.relevance(asked, F.concat_ws("\n", "source", "text"))
    return X.newest_then_relevant(docs, ["source"], [F.desc("n_chars"), "doc_id"], F.expr("TIMESTAMP_NTZ'2024-01-20'"), score, 250, 8).select("source", "doc_id", F.round("relevance", 6).alias("relevance"), "rank")


@query("p12_memory_list", f"""WITH e AS (SELECT event_id, user_id, event_type || ' ' || props AS content, ts, CASE WHEN event_id % 3 = 0 THEN ts::TIMESTAMP + to_days(5) END AS expires_at FROM events WHERE event_type <> 'error'),
n AS (SELECT *, {TERMS.format("'view or purchase'")} AS qt, {TERMS.format('content')} AS ct FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM e) WHERE r <= 250 AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20'))
SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {REL.format(q='qt', c='ct')} DESC, r) AS rank FROM n) WHERE rank <= 20""")
def memory_list(spark, d):
    """Per user: active memories, newest 250, unexpired, the 20 most relevant."""
    e = table(spark, d, "events").where("event_type <> 'error'").withColumn("content", F.concat_ws(" ", "event_type", "props"))
    e = e.withColumn("expires_at", F.expr("CASE WHEN event_id % 3 = 0 THEN CAST(ts AS TIMESTAMP_NTZ) + INTERVAL 5 DAYS END"))
    score = X.relevance(F.lit("view or purchase"), F.col("content"))
    return X.newest_then_relevant(e, ["user_id"], [F.desc("ts"), "event_id"], F.expr("TIMESTAMP_NTZ'2024-01-20'"), score, 250, 20).select("user_id", "event_id", "rank")


@query("p43_request_checks", """WITH r AS (SELECT conv_id, turn, [conv_id || ':' || turn, ' ' || turn || ' '] AS s, [CASE WHEN turn % 5 = 0 THEN turn::VARCHAR ELSE 'x' || turn END, CASE WHEN turn % 7 = 3 THEN 'a b' WHEN turn % 7 = 4 THEN '  ' ELSE 'ok' END] AS x FROM conversations),
t AS (SELECT conv_id, turn, list_distinct(list_transform(s, lambda i: trim(i))) AS s, list_distinct(list_transform(x, lambda i: trim(i))) AS x FROM r)
SELECT conv_id, turn, CASE WHEN list_contains(list_concat(s, x), '') THEN 'blank' WHEN len(list_filter(list_concat(s, x), lambda i: NOT regexp_full_match(i, '[A-Za-z0-9:_.-]+'))) > 0 THEN 'charset' WHEN list_has_any(s, x) THEN 'overlap' END AS problem FROM t""")
def request_checks(spark, d):
    turn = F.col("turn").cast("string")
    s = F.array(F.concat_ws(":", F.col("conv_id").cast("string"), turn), F.concat(F.lit(" "), turn, F.lit(" ")))
    x = F.array(F.when(F.col("turn") % 5 == 0, turn).otherwise(F.concat(F.lit("x"), turn)), F.when(F.col("turn") % 7 == 3, "a b").when(F.col("turn") % 7 == 4, "  ").otherwise("ok"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.ids_problem(s, x).alias("problem"))


@query("j21_referenced_turn", f"""WITH q AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
t AS (SELECT conv_id, turn // 2 AS turn_no, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL),
s AS (SELECT conv_id, turn_no, {REL.format(q='qt', c='ct')} AS relevance FROM (SELECT t.*, {TERMS.format('query')} AS qt, {TERMS.format('substr(content, 1, 20000)')} AS ct FROM t JOIN q USING (conv_id)))
SELECT conv_id, arg_max(turn_no, (relevance, turn_no)) AS turn_no, round(max(relevance), 6) AS relevance FROM s GROUP BY conv_id""")
def referenced_turn(spark, d):
    said = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    t = said.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("turn_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return X.referenced_turn(_asked(spark, d), t, "conv_id").select("conv_id", "turn_no", F.round("relevance", 6).alias("relevance"))
