"""Queries on facts and episodes: documents are facts, conversations' questions recall them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import memory as M
from lorebase.plans.registry import query, table

TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"


@query("x2_fact_terms", f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {TERMS.format('text')} AS t FROM documents)")
def fact_terms(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.fact_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


def _likes(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


CASES = " ".join(f"WHEN {_likes('t', words)} THEN '{name}'" for name, words in M.CATEGORIES)


@query("x22_fact_categories", f"SELECT doc_id, CASE {CASES} ELSE 'general' END AS category FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def fact_categories(spark, d):
    return table(spark, d, "documents").select("doc_id", M.category(F.col("text")).alias("category"))


@query("x18_freshness", f"""SELECT event_id, CASE WHEN v THEN 'volatile' WHEN s THEN 'time_sensitive' ELSE 'stable' END AS freshness, CASE WHEN v THEN moment + INTERVAL 1 DAY WHEN s THEN moment + INTERVAL 30 DAYS END::VARCHAR AS expires_at, strftime(moment, '%Y-%m-%dT%H') AS bucket
FROM (SELECT event_id, ts::TIMESTAMP AS moment, {_likes('t', M.VOLATILE)} AS v, {_likes('t', M.TIME_SENSITIVE)} AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts, event_type || CASE event_id % 4 WHEN 0 THEN ' 最新价格' WHEN 1 THEN ' 政策' WHEN 2 THEN ' 今天的市场' ELSE '' END AS t FROM events))""")
def freshness(spark, d):
    k = F.col("event_id") % 4
    text = F.concat("event_type", F.when(k == 0, " 最新价格").when(k == 1, " 政策").when(k == 2, " 今天的市场").otherwise(""))
    at = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    kind, until = M.freshness(text, at)
    return table(spark, d, "events").select("event_id", kind.alias("freshness"), until.cast("string").alias("expires_at"), F.date_format(at, "yyyy-MM-dd'T'HH").alias("bucket"))


@query("t8_fact_recall", f"""WITH f AS (SELECT doc_id AS fact_id, {TERMS.format('text')} AS ct, {TERMS.format("source || ' ' || lang")} AS tt, 0.5 + doc_id % 5 / 10 AS confidence, (doc_id % 60)::DOUBLE AS age FROM documents),
q AS (SELECT conv_id AS query_id, {TERMS.format('arg_max(text, turn)')} AS qt FROM conversations WHERE role = 'user' AND conv_id % 50 = 0 GROUP BY conv_id),
j AS (SELECT query_id, fact_id, len(qt) AS nq, len(ct) AS nc, len(tt) AS nt, len(list_intersect(qt, ct)) AS c, len(list_intersect(qt, tt)) AS t, confidence, age FROM f, q WHERE list_has_any(qt, ct) OR list_has_any(qt, tt)),
s AS (SELECT *, greatest(CASE WHEN c > 0 THEN c / sqrt((nq * greatest(1, nc))::DOUBLE) ELSE 0 END, CASE WHEN t > 0 THEN t / sqrt((nq * greatest(1, nt))::DOUBLE) ELSE 0 END) AS sim FROM j),
r AS (SELECT query_id, fact_id, least(1.0, sim * confidence * (1.0 + greatest(0.0, 0.1 - age / 300.0))) AS score FROM s WHERE greatest(c, t)::DOUBLE / nq >= 0.5 AND sim >= 0.2)
SELECT query_id, fact_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM r) WHERE rank <= 10""")
def fact_recall(spark, d):
    """Questions of conversations whose id 50 divides, against all documents."""
    i = F.col("doc_id")
    facts = table(spark, d, "documents").select(i.alias("fact_id"), F.col("text").alias("content"), F.concat_ws(" ", "source", "lang").alias("task"), (F.lit(0.5) + i % 5 / 10).alias("confidence"), (i % 60).cast("double").alias("age_days"))
    asked = table(spark, d, "conversations").where("role = 'user' AND conv_id % 50 = 0").groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("query"))
    return M.recall_facts(facts, asked, 10).select("query_id", "fact_id", F.round("score", 6).alias("score"), "rank")


@query("w20_recall_budget", "SELECT conv_id, turn, md5(substr(t, 1, greatest(0, 700 - before)::INT)) AS digest FROM (SELECT conv_id, turn, substr(text, 1, 300) AS t, coalesce(sum(length(substr(text, 1, 300))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)")
def recall_budget(spark, d):
    return M.budget_fold(table(spark, d, "conversations"), "conv_id", ["turn"], "text", 700, 300).select("conv_id", "turn", F.md5("taken").alias("digest"))


@query("w24_evidence_budget", "SELECT source, doc_id, length(substr(text, 1, greatest(0, 12000 - before)::INT))::BIGINT AS chars FROM (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 12000")
def evidence_budget(spark, d):
    """The last source that fits is cut, later ones are dropped."""
    t = M.first_texts(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text", 12_000)
    return t.select("source", "doc_id", F.length("taken").cast("long").alias("chars"))


@query("w12_working_view", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, length(props) DESC, value DESC, ts DESC, event_id) AS rank FROM events) WHERE rank <= 8")
def working_view(spark, d):
    e = table(spark, d, "events").withColumn("must", F.col("event_type") == "error").withColumn("score", F.length("props"))
    return M.working_view(e, "user_id", "must", "score", "value", "ts", "event_id", 8).select("user_id", "event_id", "rank")


@query("p22_source_bound", f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
r AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_+#.-]{{2,}}')) AS qt, list_distinct(regexp_extract_all(lower(before), '[a-zA-Z0-9_+#.-]{{2,}}')) AS ct FROM p WHERE before IS NOT NULL)
SELECT conv_id, turn, contains(lower(before), lower(text)) OR CASE WHEN len(qt) = 0 OR len(ct) = 0 THEN FALSE ELSE least(1.0::DOUBLE, len(list_intersect(qt, ct))::DOUBLE / len(qt) * 0.75::DOUBLE + len(list_intersect(qt, ct))::DOUBLE / least(len(ct), len(qt) * 4) * 0.25::DOUBLE) >= 0.3::DOUBLE END AS bound FROM r""")
def source_bound(spark, d):
    """Whether a message is bound to the one before: contained in it, or relevant to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    rel = T.lexical_relevance(T.lexical_terms(F.col("text")), T.lexical_terms(F.col("before")))
    return p.select("conv_id", "turn", (F.contains(F.lower("before"), F.lower("text")) | (rel >= 0.3)).alias("bound"))
