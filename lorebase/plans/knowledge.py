"""Queries on kept graphs: parts and suppliers are entities, order lines relate them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import kept_graph as KG
from lorebase.operators import knowledge as K
from lorebase.operators.kept import Store
from lorebase.operators.shared import scratch_path
from lorebase.plans.registry import query, table

CONTRIBUTIONS = "c AS (SELECT l_orderkey % 500 AS doc_id, CASE WHEN l_partkey % 97 = 0 THEN '' ELSE 'p' || l_partkey END AS source, 's' || l_suppkey AS target, l_returnflag AS type, l_discount AS weight FROM lineitem)"


def _contributions(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.when(F.col("l_partkey") % 97 == 0, "").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("weight"))


@query("j20_merged_relations", f"WITH {CONTRIBUTIONS} SELECT source, target, type, round(max(weight), 6) AS weight, count(DISTINCT doc_id) AS n_docs FROM c WHERE source <> '' GROUP BY ALL")
def merged_relations(spark, d):
    return K.merged_relations(_contributions(spark, d)).withColumn("weight", F.round("weight", 6))


@query("j9_known_ends", f"WITH {CONTRIBUTIONS}, e AS (SELECT 'p' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 <> 0) SELECT source, target, type, a.name AS source_name, b.name AS target_name FROM (SELECT DISTINCT source, target, type FROM c) JOIN e a ON a.id = source JOIN e b ON b.id = target")
def known_ends(spark, d):
    p, s = table(spark, d, "part").where("p_partkey % 3 <> 0"), table(spark, d, "supplier").where("s_suppkey % 4 <> 0")
    e = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name")).unionByName(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("name")))
    return K.with_known_ends(_contributions(spark, d).select("source", "target", "type").distinct(), e).select("source", "target", "type", "source_name", "target_name")


ENTITIES = "n AS (SELECT l_orderkey AS doc_id, l_suppkey AS entity_id, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'from ' || l_orderkey END AS name, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'kind ' || (l_orderkey % 7) END AS type FROM lineitem)"


def _entities(spark, d):
    o = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(o.alias("doc_id"), F.col("l_suppkey").alias("entity_id"), F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("from "), o.cast("string"))).alias("name"), F.when(o % 5 != 0, F.concat(F.lit("kind "), (o % 7).cast("string"))).alias("type"))


@query("g3_active_entities", f"WITH {ENTITIES} SELECT entity_id, coalesce(arg_min(name, doc_id) FILTER (name <> ''), '') AS name, coalesce(arg_min(type, doc_id) FILTER (type <> ''), '') AS type, count(DISTINCT doc_id) AS n_docs FROM n WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY entity_id")
def active_entities(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return K.active_entities(_entities(spark, d), gone)


LINKS = """e AS (SELECT DISTINCT c_custkey AS a, 1000000 + c_custkey % 97 * 1000 + floor(c_acctbal / 100)::BIGINT AS b FROM customer WHERE c_custkey % 10 <> 7),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node),
m AS (SELECT node AS entity_id, min(c) AS component FROM r GROUP BY node), z AS (SELECT component, count(*) AS n FROM m GROUP BY component HAVING count(*) >= 3 ORDER BY component LIMIT 500),
k AS (SELECT entity_id, community FROM m JOIN (SELECT component, row_number() OVER (ORDER BY component) - 1 AS community FROM z) USING (component)),
named AS (SELECT entity_id, community, CASE WHEN entity_id % 6 = 0 THEN '' ELSE 'node ' || entity_id END AS name, 't' || (entity_id % 3) AS type, 'about ' || entity_id AS description FROM k)"""


def _members(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 10 <> 7")
    rel = c.select(F.col("c_custkey").alias("source"), (F.lit(1000000) + F.col("c_custkey") % 97 * 1000 + F.floor(F.col("c_acctbal") / 100)).cast("long").alias("target"))
    e = F.col("entity_id")
    k = K.communities(rel, 3)
    return k.select("entity_id", "community", F.when(e % 6 == 0, "").otherwise(F.concat(F.lit("node "), e.cast("string"))).alias("name"), F.concat(F.lit("t"), (e % 3).cast("string")).alias("type"), F.concat(F.lit("about "), e.cast("string")).alias("description"))


@query("g2_numbered_communities", f"WITH RECURSIVE {LINKS} SELECT entity_id, community FROM k")
def numbered_communities(spark, d):
    return _members(spark, d).select("entity_id", "community")


PRINTS = """f AS (SELECT community, sha256(string_agg(h, chr(10) ORDER BY block)) AS fingerprint, sum(m)::BIGINT AS n FROM (SELECT community, entity_id // 1000 AS block, sha256(string_agg(entity_id || chr(9) || name || chr(9) || type || chr(9) || description, chr(10) ORDER BY entity_id)) AS h, count(*) AS m FROM named GROUP BY ALL) GROUP BY community)"""


@query("a24_community_fingerprints", f"WITH RECURSIVE {LINKS}, {PRINTS} SELECT community, fingerprint, n FROM f")
def community_fingerprints(spark, d):
    return K.community_fingerprints(_members(spark, d))


@query("m5_community_summaries", f"""WITH RECURSIVE {LINKS}, {PRINTS}, s AS (SELECT community, 'Entities: ' || string_agg(name, ', ' ORDER BY entity_id) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY entity_id) AS r FROM named WHERE name <> '') WHERE r <= 10 GROUP BY community)
SELECT community, CASE WHEN community % 4 = 0 THEN 'kept ' || n ELSE summary END AS summary, community % 4 = 0 AS cached FROM s JOIN f USING (community)""")
def community_summaries(spark, d):
    m = _members(spark, d)
    prints = K.community_fingerprints(m)
    cache = prints.where("community % 4 = 0").select("fingerprint", F.concat(F.lit("kept "), F.col("n").cast("string")).alias("summary"))
    return K.cached_summaries(K.default_summaries(m).join(prints, "community").select("community", "fingerprint", "summary"), cache)


@query("j10_entity_communities", f"WITH RECURSIVE {LINKS}, q AS (SELECT 2 * c_custkey AS rank, c_custkey AS entity_id FROM customer WHERE c_custkey % 7 = 0), j AS (SELECT community, min(rank) AS rank FROM q JOIN k USING (entity_id) GROUP BY community) SELECT community, rank FROM j ORDER BY rank LIMIT 3")
def entity_communities(spark, d):
    """The first three distinct communities of ranked entities."""
    q = table(spark, d, "customer").where("c_custkey % 7 = 0").select((F.col("c_custkey") * 2).alias("rank"), F.col("c_custkey").alias("entity_id"))
    return _members(spark, d).join(q, "entity_id").groupBy("community").agg(F.min("rank").alias("rank")).orderBy("rank").limit(3)


@query("x9_summary_node_ids", "SELECT conv_id, 'raptor_l' || (count(*) % 3) || '_c' || (conv_id % 10) || '_' || substr(md5(string_agg(conv_id || ':' || turn, '|' ORDER BY turn)), 1, 8) || '_' || substr(md5(max(text)), 1, 8) AS node_id FROM conversations GROUP BY conv_id")
def summary_node_ids(spark, d):
    c = table(spark, d, "conversations")
    kids = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string")))
    g = c.groupBy("conv_id").agg(kids.alias("kids"), F.max("text").alias("summary"), F.count(F.lit(1)).alias("n"))
    return g.select("conv_id", K.summary_node_id(F.col("n") % 3, F.col("conv_id") % 10, F.col("kids"), F.col("summary")).alias("node_id"))


@query("g11_kept_graph", """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, 1000000 + c_custkey % 97 * 1000 + floor(c_acctbal / 100)::BIGINT AS b FROM customer WHERE c_custkey % 10 <> 3),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node)
SELECT node AS entity_id, min(c) AS root FROM r GROUP BY node""")
def kept_graph(spark, d):
    """A graph that is built, then takes in more documents and forgets others: only components they touch are found anew."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("a"), (F.lit(1000000) + F.col("c_custkey") % 97 * 1000 + F.floor(F.col("c_acctbal") / 100)).cast("long").alias("b"))
    path = scratch_path(spark, "kept-graph")

    def said(docs):
        named = docs.select("doc_id", F.explode(F.array("a", "b")).alias("entity_id"))
        return named.select("*", F.concat(F.lit("node "), F.col("entity_id").cast("string")).alias("name"), F.lit("t").alias("type"), F.lit("").alias("description")), docs.select("doc_id", F.col("a").alias("source"), F.col("b").alias("target"), F.lit("near").alias("type"), F.lit(1.0).alias("weight"))

    KG.update(spark, path, *said(c.where("doc_id % 10 <> 7")))
    last = KG.update(spark, path, *said(c.where("doc_id % 10 = 7")), gone=c.where("doc_id % 10 = 3").select("doc_id"))
    return KG.members(Store(spark, path), last)
