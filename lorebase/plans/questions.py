"""Queries on what is asked: messages, with fixed phrases in between, are questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import questions as Q
from lorebase.plans.registry import query, table

# Phrases that reach the branches which the messages don't.
PHRASES = ["Hello!!", " (hi) ", "谢谢。", "再见", "在吗？", "怎么了", "你是谁", "抱歉", "哈哈哈", "666", "好的", "OK", "got it.", "明白了!", "compare a vs b", "how to set up a guide", "what is the latest version?", "web only: prices", "请联网查最新价格", "explain it; then; more; and; more", "brief please", "deep research of all", "see https://x.org/a", "translate this text", "verify the source", "", "   ", "ok computer"]
RESEARCH = ["latest", "today", "current version", "real-time", "search", "browse", "source", "citation", "verify", "fact check", "research report", "deep research", "medical", "legal advice", "investment"]
CONCISE, DEEP, DECISION = ["brief", "short answer"], ["deep", "in detail"], ["which", "should"]

sq = lambda s: "'" + s.replace("'", "''") + "'"
LIST = lambda words: "[" + ", ".join(map(sq, words)) + "]"
HAS = lambda words, t="t": f"len(list_filter({LIST(words)}, lambda m: contains({t}, m))) > 0"
ASKED = f"""asked AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT -generate_subscripts(p, 1), unnest(p) FROM (SELECT {LIST(PHRASES)} AS p)),
n AS (SELECT id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM asked)"""
SURFACE = f"s AS (SELECT id, text, t, regexp_replace(regexp_replace(t, {sq('^' + Q.EDGE)}, ''), {sq(Q.EDGE + '$')}, '') AS s FROM n)"
KINDS = " ".join(f"WHEN list_contains({LIST(words)}, s) THEN '{name}'" for name, words in [("greeting", Q.GREETINGS), ("thanks", Q.THANKS), ("farewell", Q.FAREWELLS), ("presence", Q.PRESENCE), ("status", Q.STATUS), ("identity", Q.IDENTITY), ("apology", Q.APOLOGIES)])
TALK = f"{ASKED}, {SURFACE}, k AS (SELECT *, CASE WHEN s <> '' AND length(s) <= 24 THEN CASE {KINDS} WHEN regexp_matches(s, {sq(Q.REACTION)}) THEN 'reaction' WHEN regexp_matches(s, {sq(Q.ACKNOWLEDGEMENT)}) THEN 'acknowledgement' END END AS kind FROM s)"


def _asked(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return c.unionByName(spark.createDataFrame([(-k, p) for k, p in enumerate(PHRASES, 1)], "id long, text string"))


@query("p24_small_talk", f"WITH {TALK} SELECT id, kind FROM k WHERE kind IS NOT NULL OR id < 0")
def small_talk(spark, d):
    return _asked(spark, d).select("id", Q.small_talk(F.col("text")).alias("kind")).where("kind IS NOT NULL OR id < 0")


@query("p25_direct_answers", f"WITH {TALK} SELECT id, t <> '' AND length(t) <= 320 AND NOT regexp_matches(t, 'https?://|www\\.') AND NOT {HAS(RESEARCH)} AND len(regexp_extract_all(t, '[。！？!?；;\\n]')) <= 3 AS direct FROM k")
def direct_answers(spark, d):
    return _asked(spark, d).select("id", Q.may_answer_directly(F.col("text"), RESEARCH).alias("direct"))


@query("p26_source_requirements", f"WITH {TALK} SELECT id, CASE WHEN t = '' OR kind IS NOT NULL OR abs(id) % 7 = 0 OR regexp_matches(t, '^(translate|rewrite|write a poem)') THEN 'not_required' WHEN abs(id) % 5 = 0 OR abs(id) % 11 = 0 OR {HAS(['verify', 'source'])} THEN 'required' ELSE 'preferred' END AS requirement FROM k")
def source_requirements(spark, d):
    i = F.abs("id")
    kind, policy = F.when(i % 7 == 0, "code").when(i % 11 == 0, "verify").otherwise("research"), F.when(i % 5 == 0, " Web ").otherwise("auto")
    return _asked(spark, d).select("id", Q.source_requirement(F.col("text"), kind, policy, "^(translate|rewrite|write a poem)", ["verify", "source"]).alias("requirement"))


@query("p27_tool_order", f"WITH {ASKED} SELECT id, CASE WHEN {HAS(Q.WEB_ONLY)} THEN 'web_search' WHEN {HAS(Q.WEB_FIRST)} THEN 'web_search,search_knowledge_base' ELSE 'search_knowledge_base,web_search' END AS tools FROM n")
def tool_order(spark, d):
    return _asked(spark, d).select("id", F.array_join(Q.tool_order(F.col("text")), ",").alias("tools"))


@query("p28_simple_tasks", f"WITH {ASKED} SELECT id, t <> '' AND length(t) <= 120 AND NOT {HAS(RESEARCH)} AND NOT regexp_matches(t, '\\b(vs|versus|compare)\\b') AND len(regexp_extract_all(t, '[。！？!?;\\n]')) <= 2 AS simple FROM n")
def simple_tasks(spark, d):
    return _asked(spark, d).select("id", Q.is_simple(F.col("text"), RESEARCH, Q.normalized(F.col("text")).rlike("\\b(vs|versus|compare)\\b")).alias("simple"))


@query("x22_task_categories", f"WITH asked AS (SELECT doc_id AS id, text FROM documents) SELECT id, CASE {' '.join(f'WHEN {HAS(w)} THEN {sq(k)}' for k, w in Q.TASK_RULES)} ELSE 'unknown' END AS category FROM (SELECT id, lower(text) AS t FROM asked)")
def task_categories(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), Q.task_category(F.col("text")).alias("category"))


DEPTHS = f"""{TALK}, b AS (SELECT *, abs(id) % 4 AS subtasks, len(regexp_extract_all(t, '[。！？!?；;\\n]')) AS breaks FROM k),
dp AS (SELECT *, CASE WHEN t = '' OR kind IS NOT NULL OR {HAS(CONCISE)} THEN 'concise' WHEN {HAS(DEEP)} OR subtasks >= 3 OR length(t) > 180 OR breaks >= 3 THEN 'deep' WHEN subtasks >= 2 OR {HAS(DECISION)} THEN 'standard' WHEN length(t) <= 100 AND breaks <= 1 THEN 'focused' ELSE 'standard' END AS depth FROM b)"""


@query("x23_response_depths", f"WITH {DEPTHS} SELECT id, depth, CASE depth WHEN 'concise' THEN 100 WHEN 'focused' THEN 500 WHEN 'standard' THEN CASE WHEN id % 2 = 0 AND subtasks >= 2 THEN 2400 ELSE 1600 END ELSE CASE WHEN id % 2 = 0 THEN 4000 ELSE 3200 END END AS least, CASE depth WHEN 'concise' THEN 500 WHEN 'focused' THEN 1200 WHEN 'standard' THEN CASE WHEN id % 2 = 0 AND subtasks >= 2 THEN 4200 ELSE 2800 END ELSE CASE WHEN id % 2 = 0 THEN 8000 ELSE 6000 END END AS most FROM dp")
def response_depths(spark, d):
    n = F.abs("id") % 4
    a = _asked(spark, d).withColumn("depth", Q.response_depth(F.col("text"), CONCISE, DEEP, DECISION, n))
    least, most = Q.depth_budget(F.col("depth"), F.col("id") % 2 == 0, n)
    return a.select("id", "depth", least.alias("least"), most.alias("most"))


@query("x24_depth_shortfalls", "SELECT doc_id, lang = 'en' AND length(trim(text)) < greatest(1600, floor(CASE WHEN doc_id % 2 = 0 THEN 4000 ELSE 1000 END * 0.75)) AS short FROM documents")
def depth_shortfalls(spark, d):
    least = F.when(F.col("doc_id") % 2 == 0, 4000).otherwise(1000)
    return table(spark, d, "documents").select("doc_id", Q.falls_short(F.col("text"), least, F.when(F.col("lang") == "en", "deep").otherwise("focused")).alias("short"))


@query("x36_query_modes", "SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'factual' ELSE ['factual', 'conceptual', 'comparative', 'procedural', 'analytical', 'graph'][least(event_id % 6, CASE WHEN event_id % 3 = 0 THEN (event_id // 6) % 6 ELSE event_id % 6 END) + 1] END AS mode FROM events")
def query_modes(spark, d):
    i = F.col("event_id")
    modes = F.array(*map(F.lit, Q.MODES))
    answer = F.concat(F.lit("Mode: "), F.initcap(F.element_at(modes, (i % 6 + 1).cast("int"))), F.when(i % 3 == 0, F.concat(F.lit(" or "), F.element_at(modes, (F.floor(i / 6) % 6 + 1).cast("int")))).otherwise("s?"))
    answer = F.when(i % 3 != 0, F.replace(answer, F.lit("s?"), F.lit("."))).otherwise(answer)
    return table(spark, d, "events").select("event_id", Q.query_mode(F.when(i % 7 == 6, "unknown!").otherwise(answer)).alias("mode"))


@query("x35_expanded_queries", "SELECT event_id, event_type || '|' || CASE WHEN event_id % 2 = 0 THEN '12: ' || props ELSE 'a.b' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE '|third' END AS queries FROM events")
def expanded_queries(spark, d):
    i = F.col("event_id")
    answer = F.concat(F.lit("1. "), "event_type", F.lit("\n\n  "), F.when(i % 2 == 0, F.concat(F.lit("12: "), "props")).otherwise("2.a.b"), F.lit(" \n3.  "), F.when(i % 3 == 0, "").otherwise("third\n4. fourth"))
    return table(spark, d, "events").select("event_id", F.array_join(Q.expanded_queries(answer), "|").alias("queries"))


@query("t4_candidate_k", "SELECT event_id, least(50, greatest(event_id % 40, 2 * (user_id % 30)))::BIGINT AS k FROM events")
def candidate_k(spark, d):
    return table(spark, d, "events").select("event_id", Q.candidate_k(F.col("event_id") % 40, F.col("user_id") % 30).alias("k"))


STOP = LIST(T.QUERY_STOP_WORDS)
GATE = f"""h AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN regexp_extract(text, '^\\S+(?:\\s+\\S+)?') ELSE (SELECT b.text FROM benchmark b WHERE b.item_id = doc_id % 40) END AS query, (doc_id % 100) / 100 AS score, doc_id % 3 AS ks FROM documents),
t AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_+#.\\-]{{1,63}}'), lambda x: lower(x)), lambda x: NOT list_contains({STOP}, x))) AS terms FROM h),
c AS (SELECT *, CASE WHEN len(terms) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(terms, lambda x: contains(lower(text), x)))::DOUBLE / len(terms) END AS share FROM t)"""


def _hits(spark, d):
    i = F.col("doc_id")
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    h = table(spark, d, "documents").join(b, i % 40 == F.col("item_id"), "left")
    return h.select("doc_id", "text", F.when(i % 2 == 0, F.regexp_extract("text", "^\\S+(?:\\s+\\S+)?", 0)).otherwise(F.col("item")).alias("query"), (i % 100 / 100).alias("score"), (i % 3).alias("ks"))


@query("x5_term_coverage", f"WITH {GATE} SELECT doc_id, len(terms)::INT AS n_terms, round(share, 6) AS coverage FROM c")
def term_coverage(spark, d):
    terms = T.query_terms(F.col("query"))
    return _hits(spark, d).select("doc_id", F.size(terms).alias("n_terms"), F.round(T.coverage(terms, F.col("text")), 6).alias("coverage"))


@query("p7_relevance_gate", f"WITH {GATE} SELECT doc_id, (len(terms) < 2 OR share = 1) AND CASE WHEN score >= 0.6 THEN len(terms) < 2 OR share >= 1.0::DOUBLE / len(terms) ELSE doc_id % 5 <> 0 AND ks > 0 AND share >= 0.6 END AS relevant FROM c")
def relevance_gate(spark, d):
    sources = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("vector"))).otherwise(F.array(F.lit("vector"), F.lit("bm25")))
    return _hits(spark, d).select("doc_id", Q.is_relevant(F.col("query"), F.col("text"), F.col("score"), F.col("ks"), sources).alias("relevant"))


@query("p4_positive_scores", "SELECT event_id FROM events WHERE event_type = 'view' AND value > 0 OR event_type = 'click'")
def positive_scores(spark, d):
    """Hits of direct search need a positive score; those of expanded queries don't."""
    e = table(spark, d, "events")
    return e.where((F.col("event_type") == "view") & (F.col("value") > 0)).unionByName(e.where("event_type = 'click'")).select("event_id")
