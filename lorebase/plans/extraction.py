"""Queries on model answers, which are made of the tables, and on trees of summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import chunking
from lorebase.operators import extraction as X
from lorebase.plans.context import REL, TERMS
from lorebase.plans.registry import query, table


def _answers(spark, d):
    """An order's lines as a model's answer: a list, with talk around it, cut short, or none."""
    k = F.col("doc_id") % 4
    s = lambda c: F.col(c).cast("string")
    entity = F.concat(F.lit('{"type": "entity", "id": "p'), s("l_partkey"), F.lit('", "name": "part ['), s("l_partkey"), F.lit('"}'))
    relation = F.concat(F.lit('{"type": "relation", "source": "p'), s("l_partkey"), F.lit('", "target": "s'), s("l_suppkey"), F.lit('", "weight": '), F.when(F.col("l_linenumber") == 2, '"none"').otherwise((F.col("l_quantity") / 25).cast("string")), F.lit("}"))
    relation = F.replace(relation, F.lit("part ["), F.lit("part "))
    entity = F.replace(entity, F.lit("part ["), F.lit("part "))
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat_ws(", ", entity, relation).alias("j")))).alias("x"))
    items = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["j"]), ", "), F.lit("]"))
    return o.select("doc_id", F.when(k == 0, items).when(k == 1, F.concat(F.lit("Here: "), items, F.lit(" done]"))).when(k == 2, F.concat(F.lit("{"), F.expr("substring(array_join(transform(x, e -> e.j), ', '), 1, 20)"))).otherwise(F.concat(F.lit("  "), items)).alias("raw"))


GIVEN = "l AS (SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_quantity, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth FROM lineitem WHERE l_orderkey % 4 <> 2)"


@query("m4_extracted_entities", f"WITH {GIVEN} SELECT doc_id, 'p' || l_partkey AS id, 'part ' || l_partkey AS name, count(*) AS n FROM l WHERE nth <= 4 GROUP BY ALL")
def extracted_entities(spark, d):
    return X.graph_items(_answers(spark, d), 4, 6)[0].groupBy("doc_id", "id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("x29_extracted_relations", f"WITH {GIVEN} SELECT doc_id, 'p' || l_partkey AS source, 's' || l_suppkey AS target, round(CASE WHEN l_linenumber = 2 THEN 1.0 ELSE least(1.0, l_quantity / 25) END, 6)::DOUBLE AS weight, count(*) AS n FROM l WHERE nth <= 6 GROUP BY ALL")
def extracted_relations(spark, d):
    r = X.graph_items(_answers(spark, d), 4, 6)[1].withColumn("weight", F.round("weight", 6))
    return r.groupBy("doc_id", "source", "target", "weight").agg(F.count(F.lit(1)).alias("n"))


ROUTES = """r AS (SELECT event_id, event_id % 6 AS k, least(1.0, value / 40) AS c, event_type AS t FROM events),
f AS (SELECT event_id, k IN (0, 1, 3) AND k <> 3 AND c >= 0.72 AS direct, k, c, t FROM r)"""


def _routes(spark, d):
    k = F.col("event_id") % 6
    c = (F.col("value") / 40).cast("string")
    body = lambda route, answer, reason: F.concat(F.lit('{"route": "' + route + '", "answer": "'), answer, F.lit('", "confidence": '), c, F.lit(', "reason": "' + reason + '"}'))
    raw = F.when(k == 0, body("direct_answer", F.col("event_type"), "")).when(k == 1, F.concat(F.lit("```json\n{oops} "), body("direct_answer", F.concat(F.lit(" "), "event_type"), "sure"), F.lit("\n```"))).when(k == 2, body("research", F.lit("x"), "needs web")).when(k == 3, body("direct_answer", F.lit(" "), "")).when(k == 4, body("other", F.lit("x"), "")).otherwise("no json")
    return table(spark, d, "events").select("event_id", X.route(raw).alias("r")).select("event_id", "r.*")


@query("x37_read_routes", f"WITH {ROUTES} SELECT event_id, CASE WHEN direct THEN 'direct_answer' ELSE 'research' END AS route, CASE WHEN direct THEN t ELSE '' END AS answer, round(CASE WHEN k = 5 THEN 0 ELSE c END, 6)::DOUBLE AS confidence FROM f")
def read_routes(spark, d):
    return _routes(spark, d).select("event_id", "route", "answer", F.round("confidence", 6).alias("confidence"))


@query("a33_route_reasons", f"WITH {ROUTES} SELECT event_id, CASE k WHEN 0 THEN CASE WHEN direct THEN '' ELSE 'below_threshold' END WHEN 1 THEN 'sure' WHEN 2 THEN 'needs web' WHEN 3 THEN 'empty_answer' ELSE '' END AS reason FROM f")
def route_reasons(spark, d):
    return _routes(spark, d).select("event_id", "reason")


@query("x20_resolved_queries", f"""WITH q AS (SELECT conv_id, arg_max(text, turn) || CASE conv_id % 3 WHEN 0 THEN ' 继续' WHEN 1 THEN ' 这个' ELSE '' END AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
t AS (SELECT conv_id, turn // 2 AS turn_no, string_agg(text, chr(10) ORDER BY turn) AS content, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 5 <> 0 GROUP BY ALL),
s AS (SELECT conv_id, turn_no, {REL.format(q='qt', c='ct')} AS relevance FROM (SELECT t.*, {TERMS.format('query')} AS qt, {TERMS.format('substr(content, 1, 20000)')} AS ct FROM t JOIN q USING (conv_id))),
b AS (SELECT conv_id, arg_max(turn_no, (relevance, turn_no)) AS turn_no FROM s WHERE conv_id % 3 <> 2 GROUP BY conv_id)
SELECT q.conv_id, q.conv_id % 3 <> 2 AS follows, b.turn_no, CASE WHEN q.conv_id % 3 = 2 THEN 1.0 WHEN b.turn_no IS NULL THEN 0.35 WHEN n = 2 THEN 0.82 ELSE 0.68 END::DOUBLE AS confidence, md5(CASE WHEN b.turn_no IS NULL THEN query ELSE content || chr(10) || chr(10) || query END) AS standalone FROM q LEFT JOIN b USING (conv_id) LEFT JOIN t ON t.conv_id = b.conv_id AND t.turn_no = b.turn_no""")
def resolved_queries(spark, d):
    c = table(spark, d, "conversations")
    k = F.col("conv_id") % 3
    q = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("q")).select("conv_id", F.concat("q", F.when(k == 0, " 继续").when(k == 1, " 这个").otherwise("")).alias("query"))
    said = c.where(F.col("role").isin("user", "assistant") & (F.col("conv_id") % 5 != 0))
    t = said.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("turn_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"), F.count(F.lit(1)).alias("n"))
    return X.resolved(q, t, "conv_id").withColumn("standalone", F.md5("standalone"))


@query("p29_unmet_expectations", """WITH p AS (SELECT l_orderkey AS id, count(*) FILTER (l_linestatus = 'F') AS ocr, count(*) FILTER (l_linestatus = 'O') AS native, count(*) FILTER (l_returnflag = 'R') AS tables, list(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1)
SELECT id, array_to_string(list_concat(list_concat(CASE WHEN ocr < 1 THEN ['ocr_pages'] ELSE [] END, CASE WHEN native < id % 3 THEN ['native_pages'] ELSE [] END), list_concat(CASE WHEN tables < 2 THEN ['tables'] ELSE [] END, list_transform(list_filter(['A', 'N'], lambda x: NOT list_contains(kinds, x)), lambda x: 'kind:' || x))), ',') AS failures FROM p""")
def unmet_expectations(spark, d):
    one = lambda c, v: F.count_if(F.col(c) == v)
    none = F.array().cast("array<string>")
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(one("l_linestatus", "F").alias("ocr_pages"), one("l_linestatus", "O").alias("native_pages"), one("l_returnflag", "R").alias("tables"), F.collect_set("l_returnflag").alias("kinds"))
    p = p.select("*", none.alias("reasons"), F.lit(1).alias("least_ocr"), (F.col("id") % 3).alias("least_native"), F.lit(2).alias("least_tables"), F.array(F.lit("A"), F.lit("N")).alias("want_kinds"), none.alias("want_reasons"))
    return X.unmet(p).select("id", F.array_join("failures", ",").alias("failures"))


def _chunk_nodes(spark, d):
    c = chunking.fixed_chunks(table(spark, d, "documents"))
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("n"), F.col("content").alias("text"))


@query("j17_chunk_clusters")
def chunk_clusters(spark, d):
    """Greedy clusters are sequential, which SQL can't say: see tests/test_edges.py."""
    n = _chunk_nodes(spark, d)
    return X.clustered(n.select("doc_id", "n", X.hash_embedding(F.col("text")).alias("v")), 0.7).select("doc_id", "n", "cluster")


@query("m3_summary_tree")
def summary_tree(spark, d):
    """Levels of summaries over the chunks of every document; see tests/test_edges.py."""
    return X.summary_tree(_chunk_nodes(spark, d)).select("doc_id", "level", "n", "n_children", F.length("text").cast("long").alias("chars"))
