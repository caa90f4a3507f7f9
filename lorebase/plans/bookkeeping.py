"""Queries on catalogs, facts, costs, citations and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import bookkeeping as B
from lorebase.operators import retrieval
from lorebase.operators.retrieval import ranked
from lorebase.plans.registry import query, table


@query("a1_catalog_stats", "SELECT count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents WHERE lang = 'en'")
def catalog_stats(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("a2_type_distribution", "SELECT event_type, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def type_distribution(spark, d):
    e = table(spark, d, "events")
    total = e.agg(F.count(F.lit(1)).alias("all"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("event_type", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("a3_catalog_backfill", "SELECT source, count(*) AS n_docs, arg_max(doc_id, doc_id) FILTER (n_chars > 100) AS last_doc, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def catalog_backfill(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.when(F.col("n_chars") > 100, F.col("doc_id"))).alias("last_doc"), F.sum("n_chars").alias("chars"))


@query("a22_index_signature", """WITH b AS (SELECT source, doc_id // 1000 AS block, sha256(string_agg(doc_id || ':' || n_chars, ';' ORDER BY doc_id, n_chars)) AS h FROM documents GROUP BY ALL),
b2 AS (SELECT source, block // 1000 AS block2, sha256(string_agg(h, ';' ORDER BY block)) AS h FROM b GROUP BY ALL), b3 AS (SELECT source, block2 // 1000 AS block3, sha256(string_agg(h, ';' ORDER BY block2)) AS h FROM b2 GROUP BY ALL)
SELECT source, sha256(string_agg(h, ';' ORDER BY block3)) AS signature FROM b3 GROUP BY source""")
def index_signature(spark, d):
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    return B.signatures(table(spark, d, "documents"), "source", "doc_id", row, ["n_chars"])


@query("a35_filtered_count", "SELECT label, count(*) AS n FROM embeddings WHERE embedding[1] > 0 GROUP BY label")
def filtered_count(spark, d):
    return table(spark, d, "embeddings").where("embedding[0] > 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("p1_filter_exclude", "SELECT lang, count(*) AS n FROM documents WHERE source = 'src0' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang")
def filter_exclude(spark, d):
    off = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").where("source = 'src0'").join(off, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("p2_disabled_documents", "SELECT doc_id FROM labels WHERE toxic = 1")
def disabled_documents(spark, d):
    return table(spark, d, "labels").where("toxic = 1").select("doc_id")


@query("p3_enabled_groups", "SELECT source, bool_or(coalesce(toxic, 0) <> 1) AS enabled, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def enabled_groups(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.bool_or(F.coalesce("toxic", F.lit(0)) != 1).alias("enabled"), F.count(F.lit(1)).alias("n"))


@query("a8_retrieval_quality", "SELECT source, round(least(avg(coalesce(quality, 0)) * 10, 10), 1) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def retrieval_quality(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.round(F.least(F.avg(F.coalesce("quality", F.lit(0))) * 10, F.lit(10.0)), 1).alias("quality"))


@query("k7_upsert", "SELECT doc_id, coalesce(l.quality::BIGINT, d.n_chars) AS value, CASE WHEN l.doc_id IS NULL THEN 'kept' WHEN d.doc_id IS NULL THEN 'added' ELSE 'replaced' END AS change FROM documents d FULL JOIN labels l USING (doc_id)")
def upsert(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("value"))
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    return B.upsert(old, new, "doc_id")


@query("k8_replace_group", "SELECT o_custkey AS grp, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1 UNION ALL SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def replace_group(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), "o_orderkey", "o_orderstatus")
    return B.replace_group(o, o.where("o_orderstatus = 'P'"), "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("k7_ordered_upsert", """WITH o AS (SELECT doc_id, n_chars AS value, row_number() OVER (ORDER BY source, doc_id) AS position FROM documents WHERE doc_id % 3 <> 1),
n AS (SELECT doc_id, max(quality)::BIGINT AS value FROM labels GROUP BY doc_id),
a AS (SELECT doc_id, value, (SELECT max(position) FROM o) + row_number() OVER (ORDER BY value DESC, doc_id) AS position FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o))
SELECT doc_id, coalesce(n.value, o.value) AS value, position FROM o LEFT JOIN n USING (doc_id) UNION ALL SELECT * FROM a""")
def ordered_upsert(spark, d):
    """Labels put into a corpus that is in an order of its own: what is there keeps its place, the rest comes behind."""
    old = ranked(table(spark, d, "documents").where("doc_id % 3 <> 1").select("doc_id", F.col("n_chars").alias("value"), "source", F.lit(0).alias("all")), ["all"], [F.col("source"), F.col("doc_id")], "position")
    new = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("value"))
    return B.upsert_in_order(old.select("doc_id", "value", "position"), new, "doc_id", [F.col("value").desc(), F.col("doc_id")])


@query("k8_replaced_chunks", """WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'),
r AS (SELECT o_custkey AS grp, o_orderkey AS chunk, o_orderstatus AS text FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM p)
  UNION ALL SELECT o_custkey, -1 - o_orderkey, 'new ' || o_orderpriority FROM orders WHERE o_custkey IN (SELECT o_custkey FROM p) AND o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 0, 'head' FROM p)
SELECT grp, count(*) AS n, sum(chunk)::BIGINT AS chunks, md5(string_agg(text, '|' ORDER BY chunk)) AS digest FROM r GROUP BY grp""")
def replaced_chunks(spark, d):
    """All chunks of some documents are replaced by new ones, fewer or more, of other ids and texts."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("chunk"), F.col("o_orderstatus").alias("text"), "o_orderpriority")
    touched = o.where("text = 'P'").select("grp").distinct()
    new = o.join(touched, "grp", "left_semi").where("chunk % 2 = 0").select("grp", (-1 - F.col("chunk")).alias("chunk"), F.concat(F.lit("new "), "o_orderpriority").alias("text"))
    new = new.unionByName(touched.select("grp", F.lit(0).cast("long").alias("chunk"), F.lit("head").alias("text")))
    g = B.replace_group(o.drop("o_orderpriority"), new, "grp").groupBy("grp")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"])
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("chunk").alias("chunks"), F.md5(F.array_join(in_order, "|")).alias("digest"))


@query("a19_recalled_episodes", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS episode, count(*) AS n FROM k WHERE r <= 30 GROUP BY ALL""")
def recalled_episodes(spark, d):
    """The latest episode of exactly a task, among a user's newest thirty that haven't expired."""
    kept = B.prune(table(spark, d, "events"), ["user_id"], "ts", "event_id", F.lit("2024-01-10").cast("timestamp_ntz"), 30)
    return kept.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("episode"), F.count(F.lit(1)).alias("n"))


@query("k9_delete_document", "SELECT count(*) AS kept, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS deleted FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_document(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("gone"))
    j = table(spark, d, "lineitem").select("l_orderkey").join(gone, "l_orderkey", "left")
    return j.agg(F.count_if(F.col("gone").isNull()).alias("kept"), F.count("gone").alias("deleted"))


@query("a20_fact_dedupe", "SELECT substr(md5(text), 1, 12) AS fact_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, max(n_chars) AS confidence, max(doc_id) AS at, count(*) AS n FROM documents GROUP BY text")
def fact_dedupe(spark, d):
    f = table(spark, d, "documents").select(F.col("text").alias("content"), "source", F.col("n_chars").alias("confidence"), F.col("doc_id").alias("at"))
    return B.dedupe_facts(f)


@query("a21_fact_prune", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE r <= 20")
def fact_prune(spark, d):
    e = table(spark, d, "events")
    return B.prune(e, ["user_id"], "ts", "event_id", F.lit("2024-01-10").cast("timestamp_ntz"), 20).select("event_id", "user_id")


@query("a19_episode_recall", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS episode, count(*) AS n FROM events GROUP BY ALL")
def episode_recall(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("episode"), F.count(F.lit(1)).alias("n"))


PRICES = [("a:m0", 2.5, 1.25, 10.0), ("m1", 0.15, None, 0.6), ("m2", 3.0, 0.3, 15.0), ("b:m1", 0.2, 0.1, 0.8)]
USAGE_SQL = """usage AS (SELECT l_orderkey AS run_id, l_linenumber AS call_no, 'm' || (l_partkey % 4) AS model, CASE l_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'local' END AS provider,
  (l_quantity * 100)::BIGINT AS prompt, (l_quantity * 20)::BIGINT AS cached, (l_linenumber * 37)::BIGINT AS completion FROM lineitem),
prices(name, input, cached_input, output) AS (VALUES ('a:m0', 2.5::DOUBLE, 1.25::DOUBLE, 10.0::DOUBLE), ('m1', 0.15, NULL, 0.6), ('m2', 3.0, 0.3, 15.0), ('b:m1', 0.2, 0.1, 0.8)),
p AS (SELECT u.*, coalesce(e.input, l.input) AS i, CASE WHEN e.name IS NOT NULL THEN coalesce(e.cached_input, e.input) ELSE coalesce(l.cached_input, l.input) END AS c, coalesce(e.output, l.output) AS o
  FROM usage u LEFT JOIN prices e ON e.name = provider || ':' || model LEFT JOIN prices l ON l.name = model),
calls AS (SELECT *, CASE WHEN provider = 'local' THEN 'not_applicable' WHEN i IS NULL THEN 'pricing_unconfigured' ELSE 'estimated' END AS status,
  round(CASE WHEN provider = 'local' THEN 0.0::DOUBLE ELSE (greatest(prompt - cached, 0) * i + cached * c + completion * o) / 1e6::DOUBLE END, 10) AS cost FROM p)"""


def _calls(spark, d):
    provider = F.when(F.col("l_suppkey") % 3 == 0, "a").when(F.col("l_suppkey") % 3 == 1, "b").otherwise("local")
    u = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("call_no"), F.concat(F.lit("m"), (F.col("l_partkey") % 4).cast("string")).alias("model"), provider.alias("provider"),
        (F.col("l_quantity") * 100).cast("long").alias("prompt"), (F.col("l_quantity") * 20).cast("long").alias("cached"), (F.col("l_linenumber") * 37).cast("long").alias("completion"),
    )
    return B.priced(u, spark.createDataFrame(PRICES, "name string, input double, cached_input double, output double"))


@query("x26_call_costs", f"WITH {USAGE_SQL} SELECT run_id, call_no, status, round(cost, 8) AS cost FROM calls")
def call_costs(spark, d):
    return _calls(spark, d).select("run_id", "call_no", "status", F.round("cost", 8).alias("cost"))


@query("a7_cost_rollup", f"""WITH {USAGE_SQL}, s AS (SELECT run_id, count(*) FILTER (status = 'estimated') AS e, count(*) FILTER (status = 'pricing_unconfigured') AS m, round(sum(cost) FILTER (status = 'estimated'), 6) AS cost FROM calls GROUP BY 1)
SELECT run_id, CASE WHEN e > 0 THEN cost END AS cost, CASE WHEN e > 0 AND m > 0 THEN 'partial' WHEN e > 0 THEN 'estimated' WHEN m > 0 THEN 'pricing_unconfigured' ELSE 'not_applicable' END AS status FROM s""")
def cost_rollup(spark, d):
    return B.cost_status(_calls(spark, d), "run_id")


@query("a6_usage_sums", f"WITH {USAGE_SQL} SELECT model, sum(prompt)::BIGINT AS prompt, sum(cached)::BIGINT AS cached, sum(completion)::BIGINT AS completion, count(*) AS calls FROM usage GROUP BY model")
def usage_sums(spark, d):
    return _calls(spark, d).groupBy("model").agg(F.sum("prompt").alias("prompt"), F.sum("cached").alias("cached"), F.sum("completion").alias("completion"), F.count(F.lit(1)).alias("calls"))


@query("j11_citation_check", """WITH m AS (SELECT o_orderkey AS report_id, unnest([(o_custkey % 7 + 1)::INT, (o_orderkey % 5 + 1)::INT, (o_custkey % 3 + 1)::INT]) AS i FROM orders),
s AS (SELECT DISTINCT l_orderkey AS report_id, l_linenumber AS i FROM lineitem),
a AS (SELECT o_orderkey AS report_id, list_sort(list_distinct([(o_custkey % 7 + 1)::INT, (o_orderkey % 5 + 1)::INT, (o_custkey % 3 + 1)::INT])) AS ms FROM orders),
h AS (SELECT report_id, list_sort(list(i)) AS ss FROM s GROUP BY 1),
j AS (SELECT a.report_id, ms, coalesce(ss, []::INT[]) AS ss FROM a LEFT JOIN h USING (report_id)),
v AS (SELECT m.report_id, count(*) AS n_markers, count(s.i) AS n_valid FROM m LEFT JOIN s ON s.report_id = m.report_id AND s.i = m.i GROUP BY 1)
SELECT report_id, n_markers, n_valid, array_to_string(list_filter(ms, lambda x: list_contains(ss, x)), ',') AS used, array_to_string(list_filter(ss, lambda x: NOT list_contains(ms, x)), ',') AS unused, array_to_string(list_filter(ms, lambda x: NOT list_contains(ss, x)), ',') AS invalid FROM j JOIN v USING (report_id)""")
def citation_check(spark, d):
    mark = lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("] "))
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.concat(F.lit("Found "), mark(F.col("o_custkey") % 7 + 1), mark(F.col("o_orderkey") % 5 + 1), mark(F.col("o_custkey") % 3 + 1)).alias("report"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("index"))
    return B.verify_citations(r, s)


@query("a11_source_numbers", "WITH f AS (SELECT o_custkey AS run_id, l_suppkey AS source, min((o_orderkey, l_linenumber, l_suppkey)) AS at_ FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) SELECT run_id, source, row_number() OVER (PARTITION BY run_id ORDER BY at_) AS index FROM f")
def source_numbers(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return B.number_sources(j.select(F.col("o_custkey").alias("run_id"), F.col("l_suppkey").alias("source"), "o_orderkey", "l_linenumber"), ["run_id"], "source", ["o_orderkey", "l_linenumber", "source"])


@query("t12_citation_sources", "SELECT run_id, min(source) AS source, idx FROM (SELECT l_orderkey AS run_id, l_suppkey AS source, l_linenumber AS idx FROM lineitem) GROUP BY run_id, idx")
def citation_sources(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("idx")).agg(F.min("l_suppkey").alias("source"))


@query("t7_similar_episodes", """WITH e AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(substr(text, 1, 200)), ' '), lambda x: x <> '')) AS w FROM documents),
q AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM benchmark WHERE item_id % 50 = 0),
s AS (SELECT item_id, doc_id, len(list_intersect(q.w, e.w))::BIGINT AS score FROM q, e)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 5""".replace("substr(text, 1, 200)", "text"))
def similar_episodes(spark, d):
    terms = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda x: x != ""))
    q = table(spark, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.explode(terms("text")).alias("w"))
    e = table(spark, d, "documents").select("doc_id", F.explode(terms("text")).alias("w"))
    s = e.join(q, "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    return retrieval.top_k(s, ["item_id"], [F.desc("score"), F.col("doc_id")], 5).select("item_id", "doc_id", "score")
