"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import conversations as C
from lorebase.plans.registry import query, table


@query("w2_recency_rank", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1)::INT AS recency FROM conversations")
def recency_rank(spark, d):
    return C.recency(table(spark, d, "conversations")).select("conv_id", "turn", "recency")


TURNS = """turns AS (SELECT conv_id, turn_no, min(CASE WHEN role = 'user' THEN turn END) AS asked, max(CASE WHEN role = 'assistant' THEN turn END) AS answered
FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY ALL)"""


@query("w3_conversation_turns", f"WITH {TURNS} SELECT conv_id, turn_no, asked, answered FROM turns")
def conversation_turns(spark, d):
    return C.turns(table(spark, d, "conversations")).select("conv_id", "turn_no", "asked", "answered")


@query("w3_latest_turn", f"WITH {TURNS} SELECT conv_id, max(turn_no) AS turn_no, arg_max(asked, turn_no) AS asked FROM turns WHERE asked IS NOT NULL GROUP BY conv_id")
def latest_turn(spark, d):
    return C.turns(table(spark, d, "conversations")).where("asked IS NOT NULL").groupBy("conv_id").agg(F.max("turn_no").alias("turn_no"), F.max_by("asked", "turn_no").alias("asked"))


@query("p8_visible_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 4")
def visible_messages(spark, d):
    return C.visible(table(spark, d, "conversations"), 4).select("conv_id", "turn", "role")


@query("p8_selected_messages", """WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant') AND (conv_id * 7 + turn) % 10 <> 0)
SELECT conv_id, turn, role, CASE WHEN r <= 2 THEN 'newest' ELSE 'selected' END AS why FROM m WHERE r <= 2 OR (conv_id + turn) % 3 = 0""")
def selected_messages(spark, d):
    """Every tenth message was deleted, every third picked; a message that was deleted stays away though it was picked."""
    c = table(spark, d, "conversations")
    deleted = (F.col("conv_id") * 7 + F.col("turn")) % 10 == 0
    return C.visible_or_selected(c, deleted, c.where("(conv_id + turn) % 3 = 0"), 2, ["conv_id", "turn"]).select("conv_id", "turn", "role", "why")


@query("w21_summary_refresh", "SELECT conv_id, min(turn) AS from_turn, max(turn) AS to_turn, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_all, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE n_all > 4 AND r > 2 GROUP BY conv_id")
def summary_refresh(spark, d):
    return C.refresh_window(table(spark, d, "conversations"), 4, 2)


@query("k30_keep_newest", "SELECT role, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY turn DESC, conv_id DESC) AS r FROM conversations) WHERE r <= 100")
def keep_newest(spark, d):
    w = Window.partitionBy("role").orderBy(F.desc("turn"), F.desc("conv_id"))
    return table(spark, d, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 100").select("role", "conv_id", "turn")


@query("t10_history_page", "SELECT conv_id, turn, substr(text, 1, 500) AS preview, count(*) OVER () AS total FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 20 OFFSET 20")
def history_page(spark, d):
    users = table(spark, d, "conversations").where("role = 'user'")
    total = users.agg(F.count(F.lit(1)).alias("total"))
    page = users.orderBy(F.desc("conv_id"), F.desc("turn")).offset(20).limit(20)
    return page.crossJoin(F.broadcast(total)).select("conv_id", "turn", F.substring("text", 1, 500).alias("preview"), "total")


RELEVANCE = """q AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_+#.-]{2,}')) AS qt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1),
c AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS rec, list_distinct(regexp_extract_all(lower(substr(text, 1, 20000)), '[a-zA-Z0-9_+#.-]{2,}')) AS ct FROM conversations),
rel AS (SELECT conv_id, turn, text, role, rec, CASE WHEN len(qt) = 0 OR len(ct) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, len(list_intersect(qt, ct))::DOUBLE / len(qt) * 0.75::DOUBLE + len(list_intersect(qt, ct))::DOUBLE / least(len(ct), len(qt) * 4) * 0.25::DOUBLE) END AS relevance FROM c JOIN q USING (conv_id)),
scored AS (SELECT conv_id, turn, text, round(greatest(0.0::DOUBLE, relevance + CASE WHEN role = 'system' THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rec = 0 THEN 0.35::DOUBLE ELSE greatest(0.0::DOUBLE, 0.2::DOUBLE - rec * 0.03::DOUBLE) END), 6) AS score FROM rel)"""


def _scored(spark, d):
    c = C.recency(table(spark, d, "conversations"))
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("qtext")).select("conv_id", T.lexical_terms(F.col("qtext")).alias("qt"))
    r = c.withColumn("ct", T.lexical_terms(F.substring("text", 1, 20000))).join(asked, "conv_id")
    relevance = T.lexical_relevance(F.col("qt"), F.col("ct"))
    score = C.context_score(relevance, F.col("recency"), F.col("role") == "system", F.col("recency") == 0, F.lit(None).cast("double"))
    return r.select("conv_id", "turn", "text", F.round(score, 6).alias("score"))


@query("t6_context_rank", f"WITH {RELEVANCE} SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS rank FROM scored")
def context_rank(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("turn"))
    return _scored(spark, d).select("conv_id", "turn", "score", F.row_number().over(w).cast("long").alias("rank"))


@query("w9_token_budget", """WITH RECURSIVE m AS (SELECT conv_id, turn, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
c AS (SELECT conv_id, turn, i, md5(substr(t, 1, 4000)) AS h, CASE WHEN t = '' THEN 0 ELSE greatest(1, ceil(length(substr(t, 1, 4000)) / 4.0::DOUBLE))::BIGINT END AS tokens FROM m),
f AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS used, []::VARCHAR[] AS seen, NULL::BIGINT AS turn, 0::BIGINT AS tokens, '' AS verdict FROM (SELECT DISTINCT conv_id FROM c)
  UNION ALL
  SELECT c.conv_id, c.i, CASE WHEN c.tokens > 0 AND NOT list_contains(seen, h) AND used + c.tokens <= 200 THEN used + c.tokens ELSE used END,
    CASE WHEN c.tokens > 0 AND NOT list_contains(seen, h) AND used + c.tokens <= 200 THEN list_append(seen, h) ELSE seen END,
    c.turn, c.tokens, CASE WHEN c.tokens = 0 THEN 'empty' WHEN list_contains(seen, h) THEN 'duplicate' WHEN used + c.tokens > 200 THEN 'budget_exceeded' ELSE 'selected' END
  FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
SELECT conv_id, turn, tokens, verdict FROM f WHERE i > 0""")
def token_budget(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("text", "content")
    return C.allocate_budget(c, "conv_id", ["turn"], 200).select("conv_id", "turn", "tokens", "verdict")


@query("w23_emission_chunks", "SELECT conv_id, turn, i::INT AS chunk_no, substr(text, (i * 512 + 1)::INT, 512) AS chunk FROM conversations, range(0, 4096) r(i) WHERE role = 'assistant' AND i * 512 < length(text)")
def emission_chunks(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant' AND length(text) > 0")
    c = c.select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / 512).cast("int"))).alias("chunk_no"))
    return c.select("conv_id", "turn", "chunk_no", F.expr("substr(text, chunk_no * 512 + 1, 512)").alias("chunk"))


@query("j18_merge_by_id", """WITH recent AS (SELECT *, 1 AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2),
picked AS (SELECT *, 0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r <= 2),
u AS (SELECT conv_id, turn, p FROM recent UNION ALL SELECT conv_id, turn, p FROM picked)
SELECT conv_id, turn, CASE WHEN min(p) = 0 THEN 'picked' ELSE 'recent' END AS origin FROM u GROUP BY conv_id, turn""")
def merge_by_id(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id")
    recent = c.withColumn("r", F.row_number().over(w.orderBy(F.desc("turn")))).where("r <= 2").select("conv_id", "turn", F.lit(1).alias("p"))
    picked = c.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.length("text")), "turn"))).where("r <= 2").select("conv_id", "turn", F.lit(0).alias("p"))
    return recent.unionByName(picked).groupBy("conv_id", "turn").agg(F.when(F.min("p") == 0, "picked").otherwise("recent").alias("origin"))


@query("x21_structured_summary", "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, arg_min(substr(text, 1, 120), turn) FILTER (role = 'user') AS first_question, arg_max(substr(text, 1, 120), turn) FILTER (role = 'assistant') AS last_answer, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def structured_summary(spark, d):
    c = table(spark, d, "conversations")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    head = F.substring("text", 1, 120)
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(user).alias("n_user"), F.min_by(head, F.when(user, F.col("turn"))).alias("first_question"), F.max_by(head, F.when(assistant, F.col("turn"))).alias("last_answer"), F.sum(F.length("text")).alias("chars"))


@query("j7_run_siblings", "SELECT a.conv_id, a.turn, count(*) AS n, min(b.turn) AS first_turn, max(b.turn) AS last_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn // 2 = b.turn // 2 GROUP BY ALL")
def run_siblings(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("run"))
    w = Window.partitionBy("conv_id", "run")
    return c.select("conv_id", "turn", F.count(F.lit(1)).over(w).alias("n"), F.min("turn").over(w).alias("first_turn"), F.max("turn").over(w).alias("last_turn"))


@query("g9_forget_conversations", "SELECT role, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY role")
def forget_conversations(spark, d):
    c = table(spark, d, "conversations")
    return c.join(c.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").groupBy("role").agg(F.count(F.lit(1)).alias("n"))
