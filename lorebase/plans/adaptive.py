"""Queries on adaptive retrieval and on functions that the caller passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions.text import hash_embedding
from lorebase.operators import adaptive, answers, kept_graph
from lorebase.operators.questions import MODES
from lorebase.operators.shared import scratch_path, written
from lorebase.plans.registry import query, table

WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
MODE_LIST = "[" + ", ".join(f"'{m}'" for m in MODES) + "]"
STRATEGY_VALUES = ", ".join(f"('{m}', {h}, {x}, {v}::DOUBLE, {b}::DOUBLE, {g})" for m, h, x, v, b, g in adaptive.STRATEGIES)
ASKED = f"""
st(mode, use_hyde, use_multi_query, vw, bw, use_graph) AS (VALUES {STRATEGY_VALUES}),
asked AS (SELECT conv_id * 6 + i - 1 AS query_id, text, {MODE_LIST}[i] AS mode FROM conversations, range(1, 7) r(i) WHERE turn = 0 AND conv_id % 50 = 0),
q AS (SELECT * FROM asked JOIN st USING (mode))"""


def _questions(spark, d):
    """The first turns of the conversations asked for, in each of the six modes."""
    first = table(spark, d, "conversations").where("turn = 0 AND conv_id % 50 = 0").select("conv_id", "text", F.posexplode(F.array(*map(F.lit, MODES))).alias("i", "mode"))
    return first.select((F.col("conv_id") * 6 + F.col("i")).alias("query_id"), "text", "mode")


@query("m6_routed_queries", f"WITH {ASKED} SELECT query_id, mode, use_hyde, use_multi_query, vw AS vector_weight, bw AS bm25_weight, use_graph FROM q")
def routed_queries(spark, d):
    return adaptive.routed(_questions(spark, d)).select("query_id", "mode", "use_hyde", "use_multi_query", "vector_weight", "bm25_weight", "use_graph")


def _passage(texts):
    """Stands for a model that writes a passage: a text's beginning."""
    return [t[:120] for t in texts]


def _rewritten(texts):
    """Stands for a model that writes a question in three ways: its parts."""
    flat = [t.replace("\n", " ") for t in texts]
    return [f"1. {t[:60]}\n2. {t[60:160]}\n3. {t[-80:]}" for t in flat]


ANSWERS = """
flat AS (SELECT *, replace(text, chr(10), ' ') AS t FROM q),
lines AS (SELECT query_id, text, list_filter([trim(substr(t, 1, 60)), trim(substr(t, 61, 100)), trim(substr(t, greatest(length(t) - 79, 1), 80))], lambda x: x <> '') AS l FROM flat WHERE use_multi_query),
many AS (SELECT query_id, generate_subscripts(l, 1) AS nth, unnest(l) AS text FROM (SELECT query_id, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l FROM lines)),
passages AS (SELECT query_id, trim(substr(text, 1, 120)) AS text FROM q WHERE use_hyde)"""


@query("m7_expanded_queries", f"WITH {ASKED}, {ANSWERS} SELECT query_id, 'multi_query' AS kind, nth::BIGINT AS nth, md5(text) AS digest FROM many UNION ALL SELECT query_id, 'hyde', 0, md5(text) FROM passages WHERE text <> ''")
def expanded(spark, d):
    """What passed functions make of the questions, asked once for each text and read from where it is kept."""
    q = adaptive.routed(_questions(spark, d))
    told = {name: answers.kept_answers(spark, scratch_path(spark, "answers"), q.where(which).select("text"), call) for name, which, call in (("hyde", "use_hyde", _passage), ("multi", "use_multi_query", _rewritten))}
    lines = adaptive.expanded_queries(F.coalesce("answer", F.lit("")))
    many = answers.with_answers(q.where("use_multi_query"), told["multi"]).select("query_id", F.posexplode(F.when(F.size(lines) > 0, lines).otherwise(F.array("text"))).alias("nth", "line"))
    passage = answers.with_answers(q.where("use_hyde"), told["hyde"]).select("query_id", F.trim("answer").alias("line")).where("line <> ''")
    return many.select("query_id", F.lit("multi_query").alias("kind"), (F.col("nth") + 1).cast("long").alias("nth"), F.md5("line").alias("digest")).unionByName(passage.select("query_id", F.lit("hyde").alias("kind"), F.lit(0).cast("long").alias("nth"), F.md5("line").alias("digest")))


GRAPH = """
ents AS (SELECT 'n' || n_nationkey AS eid, n_name AS name, r_name AS about, n_regionkey AS community, n_nationkey AS doc FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name, NULL, r_regionkey, 100 + r_regionkey FROM region),
rels AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'in' AS type, (n_nationkey % 9 + 1) / 10.0::DOUBLE AS weight, n_nationkey AS doc FROM nation),
gterm AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS term FROM q WHERE use_graph),
graw AS (SELECT query_id, eid, sum(CASE WHEN contains(lower(name), term) THEN 2 ELSE 0 END + CASE WHEN contains(lower(coalesce(about, '')), term) THEN 1 ELSE 0 END)::DOUBLE AS raw FROM gterm, ents GROUP BY ALL HAVING raw > 0),
gshare AS (SELECT query_id, eid, raw / max(raw) OVER (PARTITION BY query_id) AS share FROM graw),
gbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, eid) AS rank FROM gshare) WHERE rank <= {k}),
gcomm AS (SELECT query_id, community FROM (SELECT query_id, community, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), community) AS r FROM gbest JOIN ents USING (eid) GROUP BY query_id, community) WHERE r <= 3),
gnear AS (SELECT DISTINCT query_id, source, target, type, weight, doc FROM rels JOIN gbest ON eid = source OR eid = target),
graph AS (
  SELECT query_id, 'entity_' || eid AS id, share AS score, [doc] AS docs FROM gbest JOIN ents USING (eid)
  UNION ALL SELECT query_id, 'community_' || c.community, round(coalesce(sum(share), 0) / count(*), 4), list(doc) FROM gcomm c JOIN ents e ON e.community = c.community LEFT JOIN gshare s USING (query_id, eid) GROUP BY query_id, c.community
  UNION ALL SELECT query_id, concat_ws('_', 'rel', source, target, type), round(weight / max(weight) OVER (PARTITION BY query_id) * 0.5, 4), [doc] FROM gnear)""".replace("\\\\s", "\\s")


def _graph(spark, d):
    """Nations and regions, what is written of them in a document each, and their search."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation, region = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    r = table(spark, d, "region")
    ents = n.select(nation.alias("entity_id"), F.col("n_name").alias("name"), F.col("r_name").alias("description"), F.col("n_regionkey").cast("long").alias("community"), F.col("n_nationkey").cast("long").alias("doc"))
    ents = ents.unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("entity_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("description"), F.col("r_regionkey").cast("long").alias("community"), (F.col("r_regionkey") + 100).cast("long").alias("doc")))
    rels = n.select(nation.alias("source"), region.alias("target"), F.lit("in").alias("type"), ((F.col("n_nationkey") % 9 + 1) / 10.0).cast("double").alias("weight"), F.col("n_nationkey").cast("long").alias("doc"))
    docs = ents.select(F.concat(F.lit("entity_"), "entity_id").alias("id"), F.array("doc").alias("doc_ids"))
    docs = docs.unionByName(ents.groupBy("community").agg(F.collect_list("doc").alias("doc_ids")).select(F.concat(F.lit("community_"), F.col("community").cast("string")).alias("id"), "doc_ids"))
    docs = docs.unionByName(rels.select(F.concat_ws("_", F.lit("rel"), "source", "target", "type").alias("id"), F.array("doc").alias("doc_ids")))

    def search(queries, k=20):
        return kept_graph.graph_hits(queries, ents, rels, ents.select("entity_id", "community"), k, min(3, k)).join(docs, "id")

    return search


@query("t9_graph_hits", f"WITH {ASKED}, {GRAPH.format(k=5)} SELECT query_id, id, round(score, 6) AS score, len(docs)::BIGINT AS n_docs FROM graph")
def graph_hits(spark, d):
    """Entities, communities and relations that the words of the questions lead to."""
    out = _graph(spark, d)(_questions(spark, d).where("mode = 'graph'").select("query_id", "text"), 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.size("doc_ids").cast("long").alias("n_docs"))


@query("m11_adaptive_retrieval", rf"""WITH {ASKED}, {ANSWERS}, {GRAPH.format(k=20)},
off AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
asks AS (SELECT query_id, 0 AS nth, text FROM q UNION ALL SELECT query_id, nth, text FROM many),
tok AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
ask_terms AS (SELECT query_id, nth, unnest(list_distinct({WORDS.format('text')})) AS term FROM asks),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM ask_terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
bm AS (SELECT query_id, nth, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
  FROM ask_terms JOIN tf USING (term) JOIN dfs USING (term), tot WHERE doc_id NOT IN (SELECT doc_id FROM off) GROUP BY ALL),
bmr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, nth ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 20),
multi AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY nth, rank) AS rank FROM bmr WHERE nth > 0),
texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM off) UNION ALL SELECT 'q', query_id, text FROM q UNION ALL SELECT 'h', query_id, text FROM passages WHERE text <> ''),
slots AS (SELECT kind, id, ('0x' || substr(md5(word), 29, 4))::BIGINT % 64 AS slot, count(*)::DOUBLE AS c FROM (SELECT kind, id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM texts) GROUP BY ALL),
vec AS (SELECT kind, id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY kind, id)) AS x FROM slots),
dots AS (SELECT a.kind, a.id AS query_id, b.id AS doc_id, sum(a.x * b.x) AS score FROM vec a JOIN vec b USING (slot) WHERE a.kind <> 'd' AND b.kind = 'd' GROUP BY ALL),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM dots) WHERE rank <= 20),
rankings AS (
  SELECT query_id, kind AS ranking, rank, doc_id FROM knn UNION ALL SELECT query_id, 'bm25', rank, doc_id FROM bmr WHERE nth = 0 UNION ALL SELECT query_id, 'multi', min(rank), doc_id FROM multi GROUP BY query_id, doc_id),
fused AS (SELECT query_id, doc_id, sum(CASE WHEN ranking IN ('q', 'h') THEN vw ELSE bw END / (60 + rank)) AS raw FROM rankings JOIN q USING (query_id) GROUP BY ALL),
normed AS (SELECT query_id, doc_id, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS score FROM fused),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS ordinal FROM normed) WHERE ordinal <= 20),
lit AS (SELECT DISTINCT query_id, id, score FROM (SELECT query_id, id, score, unnest(docs) AS doc FROM graph) WHERE doc NOT IN (SELECT doc_id FROM off)),
on_graph AS (SELECT *, 1000 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS ordinal FROM lit),
found AS (SELECT query_id, doc_id::VARCHAR AS id, score, 'hybrid' AS kind, ordinal FROM hybrid UNION ALL SELECT query_id, id, score, 'graph', ordinal FROM on_graph)
SELECT query_id, mode, rank, id, kind, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, ordinal) AS rank FROM found) JOIN q USING (query_id) WHERE rank <= 6""")
def adaptive_retrieval(spark, d):
    """The questions in all six modes, against all documents that aren't switched off."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "doc_id", "text")
    q = _questions(spark, d)
    routed = adaptive.routed(q)
    passages = answers.asked(routed.where("use_hyde").select("text"), _passage)
    expansions = answers.asked(routed.where("use_multi_query").select("text"), _rewritten)
    points = written(docs.select("id", "doc_id", hash_embedding(F.col("text")).alias("vector")), "vectors")
    off = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return adaptive.retrieve(q, docs, points, passages, expansions, _graph(spark, d), off)
