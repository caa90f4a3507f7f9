"""Queries on entity graphs, here of parts and suppliers that share order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import graph as G
from lorebase.plans.registry import query, table

REL = "rel AS (SELECT l_orderkey AS doc_id, l_partkey AS source, 10000000 + l_suppkey AS target, l_discount AS weight FROM lineitem)"


def _relations(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 10000000).alias("target"), F.col("l_discount").alias("weight"))


@query("g1_adjacency", f"WITH {REL}, b AS (SELECT source AS node, target AS neighbour FROM rel UNION SELECT target, source FROM rel) SELECT node, count(*) AS degree FROM b WHERE node <> neighbour GROUP BY node")
def adjacency(spark, d):
    return G.adjacency(_relations(spark, d)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query("g2_communities", """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, 1000000 + c_custkey % 97 * 1000 + floor(c_acctbal / 100)::BIGINT AS b FROM customer),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM w UNION SELECT w.b, r.c FROM r JOIN w ON w.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def communities(spark, d):
    b = F.lit(1000000) + F.col("c_custkey") % 97 * 1000 + F.floor(F.col("c_acctbal") / 100)
    rel = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), b.cast("long").alias("target"))
    return G.components(rel)


@query("a13_canonical_entities", "SELECT s_nationkey AS entity_id, arg_min(s_name, s_suppkey) AS name, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1")
def canonical_entities(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("doc_id"))
    return G.canonical_entities(c).select("entity_id", "name", F.col("n_docs").alias("n"))


@query("a14_relation_weights", f"WITH {REL} SELECT source, target, round(arg_min(weight, (doc_id, weight)), 6) AS weight, round(max(weight), 6) AS strongest, count(*) AS n FROM rel GROUP BY ALL")
def relation_weights(spark, d):
    rel = _relations(spark, d).withColumn("doc_id", F.struct("doc_id", "weight"))
    return G.relation_weights(rel).select("source", "target", F.round("weight", 6).alias("weight"), F.round("strongest", 6).alias("strongest"), "n")


@query("g4_delete_documents", f"""WITH {REL}, k AS (SELECT source, target, doc_id, max(weight) AS weight FROM rel WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY doc_id) AS r FROM k)
SELECT source, target, round(max(weight), 6) AS weight, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (r <= 100) AS doc_ids, count(*) AS n_docs FROM r GROUP BY ALL""")
def delete_documents(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return G.without_documents(_relations(spark, d), gone).withColumn("weight", F.round("weight", 6))


@query("t9_entity_top", f"WITH {REL}, s AS (SELECT target % 25 AS region, source, count(*) AS n FROM rel GROUP BY ALL) SELECT region, source, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, source) AS rank FROM s) WHERE rank <= 10")
def entity_top(spark, d):
    s = _relations(spark, d).groupBy((F.col("target") % 25).alias("region"), "source").agg(F.count(F.lit(1)).alias("n"))
    return G.top_per(s, ["region"], [F.desc("n"), "source"], 10).select("region", "source", "n", F.col("rank").cast("long").alias("rank"))


@query("a15_community_scores", "SELECT s_nationkey AS community, round(avg(s_acctbal / m), 4) AS score FROM supplier, (SELECT max(s_acctbal) AS m FROM supplier) GROUP BY 1")
def community_scores(spark, d):
    s = table(spark, d, "supplier")
    return s.crossJoin(F.broadcast(s.agg(F.max("s_acctbal").alias("m")))).groupBy(F.col("s_nationkey").alias("community")).agg(F.round(F.avg(F.col("s_acctbal") / F.col("m")), 4).alias("score"))


@query("g8_plan_waves", """WITH RECURSIVE t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_orderkey * 8 + l_linenumber AS task, l_quantity AS q, l_shipdate AS d FROM lineitem),
e AS (SELECT a.task, b.task AS dep FROM t a JOIN t b ON a.o = b.o AND (b.n < a.n AND b.d <= a.d OR b.n = a.n AND a.q = 50)),
dead AS (SELECT task FROM e WHERE task = dep UNION SELECT e.task FROM dead JOIN e ON e.dep = dead.task),
w AS (SELECT task, 0 AS wave FROM t UNION SELECT e.task, w.wave + 1 FROM w JOIN e ON e.dep = w.task WHERE e.task <> e.dep)
SELECT task, CASE WHEN task NOT IN (SELECT task FROM dead) THEN max(wave) END AS wave FROM w GROUP BY task""")
def plan_waves(spark, d):
    """Lines of an order wait for its earlier lines that ship no later; a line of 50 waits for itself.

    Lines of one order and number are one task.
    """
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("task"), F.col("l_quantity").alias("q"), F.col("l_shipdate").alias("d"))
    orders = t.groupBy("l_orderkey").agg(F.collect_list(F.struct("n", "task", "q", "d")).alias("lines"))
    line = orders.select(F.explode("lines").alias("a"), "lines")
    waits = lambda b: ((b["n"] < F.col("a.n")) & (b["d"] <= F.col("a.d"))) | ((b["n"] == F.col("a.n")) & (F.col("a.q") == 50))
    return G.plan_waves(line.select("a.task", F.transform(F.filter("lines", waits), lambda b: b["task"]).alias("deps")))
