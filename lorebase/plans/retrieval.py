"""Queries on documents, pages and vectors: chunks, terms, search, fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import chunking, retrieval
from lorebase.plans.registry import query, table
from lorebase.sources import pages as page_source

_SEPS = ["chr(10) || chr(10)", "chr(10)", "'。'", "'.'", "'，'", "','", "' '"]


def _cut_sql() -> str:
    cases = []
    for s in _SEPS:
        r = f"length(w) - strpos(reverse(w), reverse({s})) - length({s}) + 1"
        cases.append(f"WHEN strpos(w, {s}) > 0 AND {r} > 0 THEN s + {r} + length({s})")
    return "CASE WHEN s + 512 >= n THEN n " + " ".join(cases) + " ELSE s + 512 END"


CHUNKS = f"""
chunks AS (
  WITH RECURSIVE cut AS (
    SELECT doc_id, text, n, s, {_cut_sql()} AS e FROM (SELECT doc_id, text, length(text) AS n, 0 AS s, substr(text, 1, 512) AS w FROM documents WHERE length(text) > 0)
    UNION ALL
    SELECT doc_id, text, n, s, {_cut_sql()} AS e FROM (
      SELECT doc_id, text, n, ns AS s, substr(text, ns + 1, 512) AS w FROM (
        SELECT doc_id, text, n, CASE WHEN e - 64 <= s THEN e ELSE e - 64 END AS ns FROM cut WHERE e < n))
  )
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_no, s::INT AS chunk_start, e::INT AS chunk_end,
    substr(md5(doc_id || ':' || s || ':' || e), 1, 12) AS chunk_id, substr(text, s + 1, e - s) AS content
  FROM cut WHERE length(trim(substr(text, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(13))) > 0)
"""

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
BM25 = rf"""
tok AS (SELECT doc_id, {WORDS} AS w FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS})) AS term FROM benchmark WHERE item_id % 50 = 0),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
scored AS (
  SELECT q.query_id, tf.doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
  FROM q JOIN tf USING (term) JOIN dfs USING (term), tot GROUP BY ALL)
"""


def _queries(spark, d):
    return table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


@query("j3_bm25_topk", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20")
def bm25_topk(spark, d):
    out = retrieval.bm25(table(spark, d, "documents"), _queries(spark, d), 20)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("w4_fixed_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk_start, chunk_end, chunk_id FROM chunks")
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(table(spark, d, "documents")).select("doc_id", "chunk_no", "chunk_start", "chunk_end", "chunk_id")


SENTENCES = r"""p AS (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]\s*|[^。！？.!?]+$') AS x FROM documents),
e AS (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) AS n FROM p),
b AS (SELECT *, coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM e),
sen AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, sentence, lo, lo + length(sentence) AS hi FROM b WHERE regexp_replace(sentence, '\s+', '', 'g') <> '')"""


@query("w5_semantic_chunks", rf"""WITH {SENTENCES},
w AS (SELECT doc_id, n, unnest(list_filter(regexp_split_to_array(lower(trim(sentence)), '\s+'), lambda x: x <> '')) AS word FROM sen),
c AS (SELECT doc_id, n, ('0x' || substr(md5(word), 29, 4))::BIGINT % 64 AS slot, count(*)::DOUBLE AS c FROM w GROUP BY ALL),
v AS (SELECT doc_id, n, slot, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, n)) AS x FROM c),
d AS (SELECT a.doc_id, a.n, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.n = a.n - 1 AND a.slot = b.slot GROUP BY ALL),
m AS (SELECT s.*, CASE WHEN s.n > 1 AND round(coalesce(dot, 0) / (1 + 1e-8::DOUBLE), 9) < 0.7 THEN 1 ELSE 0 END AS new FROM sen s LEFT JOIN d USING (doc_id, n)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n)::INT AS chunk_no FROM m),
g AS (SELECT doc_id, chunk_no, min(lo)::BIGINT AS chunk_start, max(hi)::BIGINT AS chunk_end FROM k GROUP BY ALL)
SELECT *, substr(md5(doc_id || ':' || chunk_start || ':' || chunk_end), 1, 12) AS chunk_id FROM g""")
def semantic_chunks(spark, d):
    return chunking.semantic_chunks(table(spark, d, "documents"))


ELEMENT_CHUNKS = CHUNKS.replace("FROM documents", "FROM els")


@query("w6_element_chunks", rf"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS element FROM documents),
o AS (SELECT *, CASE WHEN element % 4 = 1 THEN 'table' ELSE 'text' END AS kind, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY element ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
els AS (SELECT doc || ':' || element AS doc_id, text, doc, element, kind, start FROM o WHERE NOT (kind = 'table' AND length(text) <= 512) AND regexp_replace(text, '\s+', '', 'g') <> ''),
{ELEMENT_CHUNKS}
SELECT doc AS doc_id, element, kind, 0 AS chunk_no, start::BIGINT AS chunk_start, (start + length(text))::BIGINT AS chunk_end, substr(md5(doc || ':element:' || element || ':' || start || ':' || (start + length(text))), 1, 12) AS chunk_id FROM o WHERE kind = 'table' AND length(text) <= 512 AND regexp_replace(text, '\s+', '', 'g') <> ''
UNION ALL SELECT doc, element, kind, chunk_no, (start + chunk_start)::BIGINT, (start + chunk_end)::BIGINT, substr(md5(doc || ':element:' || element || ':' || chunk_no || ':' || (start + chunk_start) || ':' || (start + chunk_end)), 1, 12) FROM chunks JOIN els USING (doc_id)""")
def element_chunks(spark, d):
    """Every line is an element, every fourth a table."""
    w = Window.partitionBy("doc_id").orderBy("element").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("element", "content"))
    e = e.withColumn("start", F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0))).withColumn("element", F.col("element").cast("long"))
    return chunking.element_chunks(e.withColumn("kind", F.when(F.col("element") % 4 == 1, "table").otherwise("text")))


@query("w7_chunk_counts", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, max(chunk_no) AS last_no, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY doc_id")
def chunk_counts(spark, d):
    c = chunking.fixed_chunks(table(spark, d, "documents"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_no").alias("last_no"), F.sum(F.length("content")).alias("chars"))


@query("w8_reconstruct", "SELECT doc_id, length(text)::BIGINT AS chars, md5(text) AS digest FROM documents WHERE length(trim(text)) > 0")
def reconstruct(spark, d):
    c = chunking.reconstruct(chunking.fixed_chunks(table(spark, d, "documents")))
    return c.select("doc_id", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


@query("k1_document_ids", "SELECT doc_id, substr(sha256(text), 1, 24) AS content_id FROM documents")
def document_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 24).alias("content_id"))


@query("m2_term_statistics", rf"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY term")
def term_statistics(spark, d):
    return retrieval.postings(table(spark, d, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("m2_document_lengths", rf"SELECT doc_id, len({WORDS})::BIGINT AS dl, len(list_distinct({WORDS}))::BIGINT AS n_terms FROM documents")
def document_lengths(spark, d):
    w = T.words(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


@query("j4_keyword_matches", rf"""
WITH q AS (SELECT item_id AS query_id, list_distinct({WORDS}) AS terms FROM benchmark WHERE item_id % 50 = 0),
t AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM q),
s AS (SELECT query_id, doc_id, count(*)::DOUBLE / max(n) AS score FROM t JOIN documents ON contains(lower(text), term) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def keyword_matches(spark, d):
    out = retrieval.keyword_matches(table(spark, d, "documents"), _queries(spark, d), 20)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("j5_bm25_without_disabled", f"""WITH {BM25.replace('FROM documents)', 'FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))')}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20""")
def bm25_without_disabled(spark, d):
    off = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    out = retrieval.bm25(table(spark, d, "documents").join(off, "doc_id", "left_anti"), _queries(spark, d), 20)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("t2_filtered_topk", f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM scored WHERE score > 0),
k AS (SELECT 20 + count(DISTINCT doc_id) AS k FROM labels WHERE toxic = 1)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM r, k WHERE r <= k AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) WHERE rank <= 20""")
def filtered_topk(spark, d):
    """The k best without excluded documents: the same rows as k enlarged by their number and filtered after, but k doesn't grow with them."""
    off = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    left = retrieval.bm25_scores(table(spark, d, "documents"), _queries(spark, d)).join(off, "doc_id", "left_anti")
    out = retrieval.top_k(left, ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], 20)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


KNN = """
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM u),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, list_dot_product(q.v, p.v) / (q.norm * p.norm) AS score FROM n q JOIN n p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
knn AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s)
"""


@query("j2_exact_knn", f"WITH {KNN} SELECT query_id, id, score, rank FROM knn WHERE rank <= 20")
def exact_knn(spark, d):
    e = table(spark, d, "embeddings")
    out = retrieval.exact_knn(e, e.where("vec_id % 50 = 0"), 20)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


KEYWORDS = rf"""
kq AS (SELECT item_id AS query_id, list_distinct({WORDS}) AS terms FROM benchmark WHERE item_id % 50 = 0),
kt AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM kq),
ks AS (SELECT query_id, doc_id, count(*)::DOUBLE / max(n) AS score FROM kt JOIN documents ON contains(lower(text), term) GROUP BY ALL)"""
RANKINGS = f"""{BM25}, {KEYWORDS}, rankings AS (
  SELECT query_id, 'bm25' AS ranking, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank, doc_id AS id FROM scored WHERE score > 0
  UNION ALL SELECT query_id, 'keyword', row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id), doc_id FROM ks
  UNION ALL SELECT query_id, 'keyword', rank + 1, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ks) WHERE doc_id % 10 = 0)"""


def _scores(spark, d):
    docs, q = table(spark, d, "documents"), _queries(spark, d)
    return {"bm25": retrieval.bm25_scores(docs, q), "keyword": retrieval.keyword_scores(docs, q)}


def _rankings(spark, d):
    """Ranks of BM25 and of keyword search; every tenth document comes up twice in the latter."""
    order = lambda: [F.round("score", 6).desc(), F.col("doc_id")]
    out = None
    for name, scores in _scores(spark, d).items():
        rows = retrieval.ranked(scores, ["query_id"], order())
        again = F.array(F.lit(0), F.lit(1)) if name == "keyword" else F.array(F.lit(0))
        twice = F.when(F.col("doc_id") % 10 == 0, again).otherwise(F.array(F.lit(0)))
        rows = rows.select("query_id", F.lit(name).alias("ranking"), "rank", F.col("doc_id").alias("id"), F.explode(twice).alias("more"))
        rows = rows.select("query_id", "ranking", (F.col("rank") + F.col("more")).cast("long").alias("rank"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("j1_rrf_fuse", f"""WITH {RANKINGS},
o AS (SELECT query_id, ranking, id, min(rank) AS rank FROM rankings GROUP BY ALL),
f AS (SELECT query_id, id, sum(CASE ranking WHEN 'keyword' THEN 0.7::DOUBLE WHEN 'bm25' THEN 0.3::DOUBLE END / (60 + rank)) AS raw, min(ranking) AS best_source FROM o GROUP BY ALL),
n AS (SELECT *, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM f)
SELECT query_id, id, round(score, 6) AS score, best_source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM n) WHERE rank <= 20""")
def rrf_fuse(spark, d):
    """Whole rankings are fused, every hit of either search."""
    out = retrieval.rrf(_rankings(spark, d), {"keyword": 0.7, "bm25": 0.3}, 20)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "best_source", F.col("rank").cast("long").alias("rank"))


@query("w1_rank_positions", f"WITH {RANKINGS} SELECT query_id, ranking, id, min(rank)::BIGINT AS best_rank, count(*) AS n FROM rankings GROUP BY ALL")
def rank_positions(spark, d):
    """The best rank of an id in each ranking, in which it may come up twice."""
    return _rankings(spark, d).groupBy("query_id", "ranking", "id").agg(F.min("rank").cast("long").alias("best_rank"), F.count(F.lit(1)).alias("n"))


@query("u2_ranking_union", f"WITH {RANKINGS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ranking, rank, id) AS position, ranking, id FROM rankings")
def ranking_union(spark, d):
    """All rankings of a query under each other, in their order."""
    order = [F.col("ranking"), F.col("rank"), F.col("id")]
    return retrieval.ranked(_rankings(spark, d), ["query_id"], order, "position").select("query_id", "position", "ranking", "id")


@query("j23_document_chunks", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, min(chunk_id) AS first_id FROM chunks WHERE doc_id % 50 = 0 GROUP BY doc_id")
def document_chunks(spark, d):
    """Chunks of the documents asked for: the filter is applied before anything is cut."""
    c = chunking.fixed_chunks(table(spark, d, "documents").where("doc_id % 50 = 0"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_id"))


@query("t5_rerank", """WITH c AS (SELECT label AS query_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS ordinal, embedding[4]::DOUBLE * 10 AS logit FROM embeddings),
s AS (SELECT *, 1 / (1 + exp(-greatest(-60, least(60, logit)))) AS score FROM c WHERE ordinal <= 100)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ordinal) AS rank FROM s) WHERE rank <= 6""")
def rerank(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), (F.col("embedding")[3].cast("double") * 10).alias("logit"))
    c = e.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return retrieval.rerank(c, 6).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-zA-Z0-9_+#.-]{{2,}}'))"


@query("x1_lexical_relevance", f"""WITH q AS (SELECT conv_id, {TERMS.format('text')} AS qt FROM conversations WHERE turn = 0),
c AS (SELECT conv_id, turn, {TERMS.format('substr(text, 1, 20000)')} AS ct FROM conversations),
j AS (SELECT c.conv_id, turn, len(qt) AS q, len(ct) AS c, len(list_intersect(qt, ct))::DOUBLE AS b FROM c JOIN q USING (conv_id))
SELECT conv_id, turn, round(CASE WHEN q = 0 OR c = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, b / q * 0.75::DOUBLE + b / least(c, q * 4) * 0.25::DOUBLE) END, 6) AS relevance FROM j""")
def lexical_relevance(spark, d):
    c = table(spark, d, "conversations")
    q = c.where("turn = 0").select("conv_id", T.lexical_terms(F.col("text")).alias("qt"))
    j = c.select("conv_id", "turn", T.lexical_terms(F.substring("text", 1, 20000)).alias("ct")).join(q, "conv_id")
    return j.select("conv_id", "turn", F.round(T.lexical_relevance(F.col("qt"), F.col("ct")), 6).alias("relevance"))


@query("x6_token_estimate", "SELECT doc_id, greatest(1, ceil(length(text) / 4.0::DOUBLE))::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("x8_point_ids", "SELECT vec_id, ((('0x' || substr(md5('v' || vec_id), 17, 1))::BIGINT % 8) * 1152921504606846976 + ('0x' || substr(md5('v' || vec_id), 18, 15))::BIGINT)::BIGINT AS point_id FROM embeddings")
def point_ids(spark, d):
    return table(spark, d, "embeddings").select("vec_id", T.point_id(F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("point_id"))


@query("x10_hash_embedding", """WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM conversations),
s AS (SELECT conv_id, turn, (('0x' || substr(md5(word), 29, 4))::BIGINT % 64)::INT AS slot, count(*)::DOUBLE AS c FROM w GROUP BY ALL)
SELECT conv_id, turn, slot, round(c / sqrt(sum(c * c) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM s""".replace("\\\\", "\\"))
def hash_embedding(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.hash_embedding(F.col("text"))).alias("slot", "weight"))
    return c.where("weight > 0").select("conv_id", "turn", "slot", F.round("weight", 6).alias("weight"))


@query("x11_fit_dimension", """WITH c AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM c)
SELECT vec_id, len(v)::INT AS size, round(v[1] / norm, 6) AS first, round(v[16] / norm, 6) AS last FROM n""")
def fit_dimension(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", T.fit_dimension(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.size("v").alias("size"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"))


@query("x12_cosine_to_centroid", """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS c FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
s AS (SELECT e.vec_id, sum(e.embedding[m.i]::DOUBLE * c) AS dot, sqrt(sum(e.embedding[m.i]::DOUBLE * e.embedding[m.i]::DOUBLE)) AS a, sqrt(sum(c * c)) AS b FROM embeddings e JOIN m ON e.label = m.label GROUP BY ALL)
SELECT vec_id, round(dot / (a * b + 1e-8), 5) AS cosine FROM s""")
def cosine_to_centroid(spark, d):
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("m"))
    return e.join(means, "label").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("m")), 5).alias("cosine"))


@query("s4_html_text", page_source.SQL)
def html_text(spark, d):
    t = page_source.html_text(table(spark, d, "pages"))
    return t.select("page_id", "title", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


URLS = "urls AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://www.') || '.html?x=1' WHEN 1 THEN url || '/index.PHP' WHEN 2 THEN url || '/some_long-title/' ELSE url END AS url FROM pages)"


@query("x32_url_titles", rf"""WITH {URLS}, h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host, trim(regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)/*$', 1)) AS last FROM urls),
s AS (SELECT page_id, host, regexp_replace(last, '(?i)\.(?:html?|php|aspx?)$', '') AS slug FROM h)
SELECT page_id, CASE WHEN slug = '' OR lower(slug) IN ('article', 'detail', 'index', 'page') OR regexp_full_match(slug, '[0-9]+') THEN CASE WHEN host <> '' THEN host ELSE 'Web source' END ELSE host || ' - ' || trim(regexp_replace(regexp_replace(slug, '[-_]+', ' ', 'g'), '\s+', ' ', 'g')) END AS title FROM s""")
def url_titles(spark, d):
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.replace("url", F.lit("://"), F.lit("://www.")), F.lit(".html?x=1"))).when(k == 1, F.concat("url", F.lit("/index.PHP"))).when(k == 2, F.concat("url", F.lit("/some_long-title/"))).otherwise(F.col("url"))
    return page_source.url_titles(table(spark, d, "pages").withColumn("url", url))


@query("s3_markdown_sections", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
m AS (SELECT doc_id, n, n % 7 + 1 AS level, trim(line) AS title FROM l WHERE n % 3 = 0 AND trim(line) <> '')
SELECT doc_id, n::INT AS line_no, level::INT AS level, md5(title) AS title FROM m WHERE level <= 6""")
def markdown_sections(spark, d):
    """Every third line becomes a heading of up to six marks, or of seven, which is none."""
    mark = lambda x, n: F.when((n % 3 == 0) & (F.trim(x) != ""), F.concat(F.repeat(F.lit("#"), n % 7 + 1), F.lit("  "), F.trim(x), F.lit(" "))).otherwise(F.concat(F.lit("."), x))
    md = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("md"))
    return page_source.markdown_headings(md, "doc_id", "md").select("doc_id", "line_no", "level", F.md5("title").alias("title"))
