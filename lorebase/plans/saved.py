"""Queries on tables that are saved and loaded, listings, and prompts under budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import saved
from lorebase.operators.shared import scratch_path
from lorebase.plans.registry import query, table


@query("s14_loaded_facts", """WITH f AS (SELECT doc_id AS fact_id, substr(coalesce(text, ''), 1, 400) AS content, coalesce(source, 'general') AS category, ([lang, source])[1:1] AS sources, doc_id % 1000 AS timestamp FROM documents WHERE doc_id % 1000 >= 100)
SELECT fact_id, md5(content) AS content, category, coalesce(substr(sources[1], 1, 1), '') AS source FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY timestamp DESC, fact_id DESC) AS r FROM f) WHERE r <= 25""")
def loaded_facts(spark, d):
    """Facts saved whole, then loaded with their texts cut, old ones gone, and the newest of each category kept."""
    f = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("category"), F.array("lang", "source").alias("sources"), (F.col("doc_id") % 1000).alias("timestamp"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("task"))
    path = scratch_path(spark, "facts")
    saved.save(spark, path, facts=f)
    out = saved.load_facts(spark, path, F.lit(100), 25, chars=400, sources=1, source_chars=1)
    return out.select("fact_id", F.md5("content").alias("content"), "category", F.coalesce(F.get("sources", F.lit(0)), F.lit("")).alias("source"))


GRAPH = """e AS (SELECT p_partkey AS entity_id FROM part WHERE p_partkey % 4 <> 2), r AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_partkey <> l_suppkey),
m AS (SELECT p_partkey AS entity_id, p_size AS community FROM part)"""


@query("s13_loaded_graph", f"""WITH {GRAPH}, both_ends AS (SELECT source AS node, target AS neighbour FROM r UNION SELECT target, source FROM r),
c AS (SELECT community, count(e.entity_id) AS n_members, min(e.entity_id) AS first FROM m LEFT JOIN e USING (entity_id) GROUP BY community)
SELECT 'node' AS kind, node AS id, count(*) AS n, min(neighbour) AS first FROM both_ends GROUP BY node UNION ALL SELECT 'community', community, n_members, first FROM c""")
def loaded_graph(spark, d):
    """A graph saved as three tables and loaded again: neighbours made anew, members that are no entity dropped."""
    part, path = table(spark, d, "part"), scratch_path(spark, "graph")
    relations = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    saved.save(spark, path, entities=part.where("p_partkey % 4 <> 2").select(F.col("p_partkey").alias("entity_id")), relations=relations, members=part.select(F.col("p_partkey").alias("entity_id"), F.col("p_size").cast("long").alias("community")))
    _, adjacency, members = saved.load_graph(spark, path)
    nodes = adjacency.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("neighbour").alias("first"))
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("id"), "n", "first").unionByName(members.select(F.lit("community").alias("kind"), F.col("community").alias("id"), F.col("n_members").alias("n"), "first"))


@query("s15_loaded_episodes", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def loaded_episodes(spark, d):
    """Episodes saved whole; of each user the ten newest are loaded."""
    path = scratch_path(spark, "episodes")
    saved.save(spark, path, episodes=table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"))
    (episodes,) = saved.load(spark, path, "episodes")
    return saved.prune(episodes, ["user_id"], "ts", "event_id", F.lit("1900-01-01").cast("timestamp_ntz"), 10).select("event_id", "user_id", "event_type")


@query("s16_listed_traces", """WITH s AS (SELECT user_id AS trace_id, max(ts) AS t, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id),
k AS (SELECT * FROM s ORDER BY t DESC, trace_id LIMIT 60)
SELECT trace_id, n, failed, (SELECT count(*) FROM s) > 60 AS truncated FROM k WHERE n % 3 <> 0 ORDER BY t DESC, trace_id LIMIT 25""")
def listed_traces(spark, d):
    """The newest 25 summaries that can be read, among the 60 that are scanned; a summary of every third count is broken."""
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("trace_id")).agg(F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return saved.listed(s, "at", "trace_id", F.col("n") % 3 != 0, 60, 25).drop("at")


@query("w19_findings", r"""WITH s AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'),
b AS (SELECT *, greatest(100, 2000 // n - 300) AS share, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM s),
l AS (SELECT conv_id, i, n, '### 子任务 ' || i || ': turn ' || turn || chr(10) || chr(10) || CASE WHEN length(t) <= share THEN t ELSE regexp_replace(substr(t, 1, share), '\s+$', '') || chr(10) || chr(10) || '[该子任务内容因上下文预算已截断]' END
  || CASE WHEN turn % 2 = 1 THEN chr(10) || chr(10) || '该子任务的引用编号映射：局部 [1] -> 全局 [' || turn || ']，局部 [2] -> 全局 [' || (turn + 1) || ']。最终答案必须改用全局编号。' ELSE '' END || chr(10) AS line FROM b),
f AS (SELECT conv_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM l GROUP BY conv_id)
SELECT conv_id, n, md5(CASE WHEN length(t) > 2000 THEN regexp_replace(substr(t, 1, 2000), '\s+$', '') || chr(10) || chr(10) || '[子任务上下文已达到综合预算上限]' ELSE t END) AS digest FROM f""")
def synthesis_findings(spark, d):
    """Answers as findings of subtasks, under a budget of 2,000 characters."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    pair = lambda a, b: F.struct(F.lit(a).cast("long").alias("local"), b.cast("long").alias("global"))
    none = F.array().cast("array<struct<local:bigint,global:bigint>>")
    s = c.select("conv_id", "turn", "text", F.concat(F.lit(" turn "), F.col("turn").cast("string")).alias("description"), F.when(F.col("turn") % 2 == 1, F.array(pair(1, F.col("turn")), pair(2, F.col("turn") + 1))).otherwise(none).alias("mapping"))
    return saved.findings(s, "conv_id", "turn", "description", "text", "mapping", 2000).select("conv_id", "n", F.md5("findings").alias("digest"))


@query("k31_captions", """SELECT page_id AS asset_id, CASE WHEN page_id % 3 = 0 THEN 'about ' || page_id WHEN page_id % 2 = 0 THEN 'old' END AS caption, CASE WHEN page_id % 3 = 0 THEN 'm1' END AS model, url, CASE WHEN page_id % 3 = 0 THEN 5 WHEN page_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM pages""")
def captions(spark, d):
    """Captions put into the metadata of some pages, over older ones at times, and for a page that isn't there."""
    p = table(spark, d, "pages")
    had = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("url"), F.col("url"), F.lit("caption"), F.lit("old"))).otherwise(F.create_map(F.lit("url"), F.col("url")))
    new = p.where("page_id % 3 = 0").select("page_id").unionByName(spark.range(1).select((F.col("id") - 5).alias("page_id")))
    new = new.select(F.col("page_id").alias("asset_id"), F.concat(F.lit("about "), F.col("page_id").cast("string")).alias("caption"), F.lit("m1").alias("model"), F.lit("p2").alias("prompt_version"))
    out = saved.captioned(p.select(F.col("page_id").alias("asset_id"), had.alias("metadata")), new, F.lit("2024-02-01T00:00:00Z"))
    m = F.col("metadata")
    return out.select("asset_id", m["caption"].alias("caption"), m["caption_model"].alias("model"), m["url"].alias("url"), F.size(m).cast("long").alias("n"))


@query("k32_qa_markdown", """WITH q AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM q)
SELECT conv_id, count(*) AS n, md5('# ' || conv_id || ' QA 测试集' || chr(10) || '> 共 ' || count(*) || ' 条问答对' || chr(10) || string_agg('### Q' || i || chr(10) || question || chr(10) || '**A:** ' || answer || chr(10) || chr(10), '' ORDER BY i)) AS digest FROM n GROUP BY conv_id""")
def qa_markdown(spark, d):
    """Questions and answers of each conversation as one Markdown file, numbered anew."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])
    return saved.qa_markdown(q, "conv_id", ["turn"]).select("conv_id", "n", F.md5("markdown").alias("digest"))


@query("a25_settings_signatures", """SELECT p_partkey, sha256('{"chunk_overlap":64,"chunk_size":' || (256 + p_size) || ',"embedding_model":"' || p_brand || '","raptor_levels":' || CASE WHEN p_partkey % 2 = 0 THEN (p_size % 4)::VARCHAR ELSE 'null' END || ',"strategy":"' || lower(p_type) || '","use_raptor":' || (p_partkey % 2 = 0)::VARCHAR || '}') AS signature FROM part""")
def settings_signatures(spark, d):
    """Settings of an index, some of which count only if another is on."""
    on = F.col("p_partkey") % 2 == 0
    settings = {"strategy": F.lower("p_type"), "chunk_size": F.col("p_size") + 256, "chunk_overlap": F.lit(64), "embedding_model": F.col("p_brand"), "use_raptor": on, "raptor_levels": F.when(on, F.col("p_size") % 4)}
    return table(spark, d, "part").select("p_partkey", saved.settings_signature(settings).alias("signature"))
