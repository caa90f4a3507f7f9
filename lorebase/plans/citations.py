"""Queries on citations: documents are reports whose clauses are marked, and each other's sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import bookkeeping as B
from lorebase.operators import citations as K
from lorebase.plans.registry import query, table

STOP = ", ".join(f"'{w}'" for w in T.CITATION_STOP_WORDS)
TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains([" + STOP + "], t)))"
REPORTS = "reports AS (SELECT doc_id AS report_id, replace(replace(text, '. ', ' [' || (doc_id % 5 + 1) || ']. '), ', ', ' [' || (doc_id % 7) || '], ') AS report FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 11 = 0)"
SOURCES = """sources AS (SELECT report_id, k::INT AS index, CASE WHEN k = 3 THEN '' ELSE coalesce(source, '') END AS title, CASE WHEN (report_id + k) % 4 = 0 THEN '' ELSE 'http://x/' || (report_id + k) END AS url, CASE WHEN k IN (3, 4) AND report_id % 2 = 0 THEN '' ELSE coalesce(text, '') END AS content, k = 1 AND report_id % 2 = 0 AS native
  FROM (SELECT doc_id AS report_id, unnest([1, 2, 3, 4]) AS k FROM documents WHERE doc_id % 13 <> 0) r LEFT JOIN documents d ON d.doc_id = report_id + k WHERE NOT (k = 2 AND report_id % 3 = 0))"""
CLAIMS = r"""claims AS (SELECT report_id, sentence, regexp_replace(s, '\[(\d+)\]', '', 'g') AS claim, list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda x: x::INT) AS markers FROM (SELECT report_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS sentence FROM (SELECT report_id, string_split_regex(report, '[.!?。！？\n]') AS p FROM reports)) WHERE regexp_matches(s, '\[(\d+)\]'))"""
MARKS = f"""{REPORTS}, {SOURCES}, {CLAIMS}, most AS (SELECT report_id, max(index) AS most FROM sources GROUP BY report_id), have AS (SELECT *, {TERMS.format("title || ' ' || content")} AS have FROM sources),
m AS (SELECT report_id, sentence, unnest(markers) AS index, {TERMS.format('claim')} AS terms FROM claims),
j AS (SELECT m.*, most, s.title, s.url, s.content, s.native, s.have, len(list_intersect(terms, have)) AS n, s.index IS NOT NULL AS known FROM m LEFT JOIN have s ON m.report_id = s.report_id AND m.index = s.index LEFT JOIN most ON most.report_id = m.report_id),
checked AS (SELECT report_id, sentence, index, CASE WHEN index < 1 OR index > coalesce(most, 0) THEN 'index_out_of_range' WHEN NOT known THEN 'missing_source' WHEN title = '' AND content = '' AND url = '' THEN 'empty_source' WHEN title = '' AND content = '' THEN 'insufficient_source_content' WHEN native THEN NULL
  WHEN NOT (len(terms) > 0 AND len(have) > 0 AND CASE WHEN len(terms) <= 2 THEN n = len(terms) ELSE n >= 2 AND n >= len(terms) * 0.2::DOUBLE END) THEN 'unsupported_claim' END AS issue FROM j)"""


def _reports(spark, d):
    i = F.col("doc_id")
    mark = lambda n: F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))
    marked = F.replace(F.replace("text", F.lit(". "), F.concat(mark(i % 5 + 1), F.lit(". "))), F.lit(", "), F.concat(mark(i % 7), F.lit(", ")))
    return table(spark, d, "documents").select(i.alias("report_id"), F.when(i % 11 != 0, marked).otherwise(F.col("text")).alias("report"))


def _sources(spark, d):
    docs = table(spark, d, "documents")
    r, k = F.col("report_id"), F.col("index")
    s = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("report_id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("index")).where(~((k == 2) & (r % 3 == 0)))
    j = s.withColumn("doc_id", r + k).join(docs.select("doc_id", "source", "text"), "doc_id", "left")
    return j.select("report_id", "index", F.when(k == 3, "").otherwise(F.coalesce("source", F.lit(""))).alias("title"), F.when((r + k) % 4 == 0, "").otherwise(F.concat(F.lit("http://x/"), (r + k).cast("string"))).alias("url"), F.when(k.isin(3, 4) & (r % 2 == 0), "").otherwise(F.coalesce("text", F.lit(""))).alias("content"), ((k == 1) & (r % 2 == 0)).alias("native"))


def _read_sources(spark, d):
    """As ``_sources``, with the terms of each text made once, and shuffled in its place."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), T.citation_terms(F.col("source")).alias("source_terms"), T.citation_terms(F.col("text")).alias("terms"), F.substring("text", 1, 1).alias("begin"))
    ids = table(spark, d, "documents").where("doc_id % 13 <> 0").select(F.col("doc_id").alias("report_id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("index"))
    r, k, none = F.col("report_id"), F.col("index"), F.array().cast("array<string>")
    j = ids.where(~((k == 2) & (r % 3 == 0))).withColumn("doc_id", r + k).join(docs, "doc_id", "left")
    untitled, empty = k == 3, k.isin(3, 4) & (r % 2 == 0)
    have = F.array_union(F.when(untitled, none).otherwise(F.coalesce("source_terms", none)), F.when(empty, none).otherwise(F.coalesce("terms", none)))
    return j.select("report_id", "index", F.when(untitled, "").otherwise(F.coalesce("source", F.lit(""))).alias("title"), F.when((r + k) % 4 == 0, "").otherwise(F.concat(F.lit("http://x/"), (r + k).cast("string"))).alias("url"), F.when(empty, "").otherwise(F.coalesce("begin", F.lit(""))).alias("content"), ((k == 1) & (r % 2 == 0)).alias("native"), have.alias("have"))


@query("x3_citation_terms", f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {TERMS.format('text')} AS t FROM documents)")
def citation_terms(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.citation_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query("x4_claim_sentences", f"WITH {REPORTS}, {CLAIMS} SELECT report_id, sentence, md5(claim) AS claim, array_to_string(markers, ',') AS markers FROM claims")
def claim_sentences(spark, d):
    return K.claims(_reports(spark, d)).select("report_id", F.col("sentence").cast("long").alias("sentence"), F.md5("claim").alias("claim"), F.array_join("markers", ",").alias("markers"))


@query("d6_checked_markers", f"WITH {MARKS} SELECT report_id, index, coalesce(issue, 'valid') AS verdict, count(*) AS n FROM checked GROUP BY ALL")
def checked_markers(spark, d):
    m = K.checked_markers(_reports(spark, d), _read_sources(spark, d))
    return m.groupBy("report_id", "index", F.coalesce("issue", F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


SUMMARY = f"""{MARKS}, c AS (SELECT report_id, count(*) AS total, count(*) FILTER (issue IS NULL) AS good, list_distinct(list(index) FILTER (issue IS NULL)) AS used FROM checked GROUP BY report_id), h AS (SELECT report_id, list(DISTINCT index) AS have FROM sources GROUP BY report_id),
a AS (SELECT report_id, have, coalesce(total, 0) AS total, coalesce(good, 0) AS good, coalesce(used, []) AS used FROM reports LEFT JOIN c USING (report_id) LEFT JOIN h USING (report_id))"""


@query("a9_citation_summary", f"WITH {SUMMARY} SELECT report_id, total AS total_markers, CASE WHEN have IS NULL THEN 0 ELSE good END AS valid_markers, round(CASE WHEN have IS NULL THEN CASE WHEN total = 0 THEN 1.0 ELSE 0.0 END WHEN total = 0 THEN 0.0 ELSE good / total END::DOUBLE, 6) AS validity, total - CASE WHEN have IS NULL THEN 0 ELSE good END AS n_issues, array_to_string(list_sort(used), ',') AS used, array_to_string(list_sort(list_filter(coalesce(have, []), lambda x: NOT list_contains(used, x))), ',') AS unused FROM a")
def citation_summary(spark, d):
    return K.citation_summary(_reports(spark, d), _sources(spark, d)).drop("status").withColumn("validity", F.round("validity", 6))


@query("a10_citation_status", f"WITH {SUMMARY} SELECT report_id, CASE WHEN have IS NULL THEN CASE WHEN total = 0 THEN 'not_applicable' ELSE 'invalid' END WHEN total = 0 OR good < total THEN 'invalid' ELSE 'valid' END AS status FROM a")
def citation_status(spark, d):
    return K.citation_summary(_reports(spark, d), _sources(spark, d)).select("report_id", "status")


HITS = "hits AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'http://u/' || (value::BIGINT % 20) ELSE '' END AS url, CASE WHEN event_id % 3 = 1 THEN event_type || props WHEN event_id % 6 = 2 THEN '' END AS chunk_id, CASE WHEN event_id % 12 = 2 THEN '' ELSE event_type END AS id FROM events)"


def _hits(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.when(e % 3 == 0, F.concat(F.lit("http://u/"), (F.round("value").cast("long") % 20).cast("string"))).otherwise("").alias("url"), F.when(e % 3 == 1, F.concat("event_type", "props")).when(e % 6 == 2, "").alias("chunk_id"), F.when(e % 12 == 2, "").otherwise(F.col("event_type")).alias("id"))


@query("a12_first_sources", f"WITH {HITS.replace('value::BIGINT', 'round(value)::BIGINT')}, i AS (SELECT *, coalesce(nullif(url, ''), nullif(chunk_id, ''), nullif(id, '')) AS identity FROM hits), f AS (SELECT user_id, identity, min(event_id) AS event_id FROM i WHERE identity IS NOT NULL GROUP BY ALL) SELECT user_id, identity, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS index FROM f")
def first_sources(spark, d):
    return K.first_sources(_hits(spark, d), ["user_id"], "event_id").select("user_id", "identity", "event_id", "index")


CALLS = "calls AS (SELECT l_orderkey AS run, l_linenumber AS call, k AS position, k + 10 AS local, (l_partkey + k * l_suppkey) % 9 AS identity FROM (SELECT *, unnest([1, 2, 3]) AS k FROM lineitem))"


def _calls(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    return c.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("call"), F.col("k").alias("position"), (F.col("k") + 10).alias("local"), ((F.col("l_partkey") + F.col("k") * F.col("l_suppkey")) % 9).alias("identity"))


NUMBERED = "n AS (SELECT run, identity, row_number() OVER (PARTITION BY run ORDER BY min(call * 10 + position), identity) AS index FROM calls GROUP BY run, identity)"


@query("a34_running_numbers", f"WITH {CALLS}, {NUMBERED} SELECT run, call, local, index FROM calls JOIN n USING (run, identity)")
def running_numbers(spark, d):
    return K.running_numbers(_calls(spark, d), "run")


@query("j12_citation_map", f"WITH {CALLS}, {NUMBERED} SELECT run, call AS task, string_agg(DISTINCT local || '=' || index, ',' ORDER BY local || '=' || index) AS citation_map FROM calls JOIN n USING (run, identity) GROUP BY ALL")
def citation_map(spark, d):
    c = _calls(spark, d).withColumnRenamed("call", "task")
    first = c.groupBy("run", "identity").agg(F.min(F.struct("task", "position")).alias("at"))
    return K.citation_map(c, B.number_sources(first, ["run"], "identity", ["at"]), "run")


@query("a32_step_outcome", """WITH b AS (SELECT i, i % 2 = 1 AS req, i // 2 % 2 = 1 AS strict, i // 4 % 2 = 1 AS src, i // 8 % 2 = 1 AS mark, i // 16 % 2 = 1 AS txt, i // 32 % 2 = 1 AS fb FROM range(64) r(i)), t AS (SELECT event_id, event_type, b.* FROM events JOIN b ON i = (event_id * 7 + user_id) % 64),
o AS (SELECT *, req AND NOT src AND fb AND txt AS alone FROM t)
SELECT event_id, CASE WHEN src AND mark THEN 'available' WHEN src THEN 'missing_markers' WHEN req THEN 'unavailable' ELSE 'not_required' END AS citation_status,
 CASE WHEN alone THEN 'model_only' WHEN req AND src AND mark THEN 'grounded' WHEN NOT req THEN 'not_required' ELSE 'unavailable' END AS grounding_status, CASE WHEN alone AND strict THEN 'degraded' ELSE 'success' END AS outcome,
 CASE WHEN alone THEN CASE WHEN strict THEN 'sources_unavailable' END WHEN req AND NOT src THEN 'sources_unavailable' WHEN req AND NOT mark THEN 'citation_markers_missing' END AS failure_reason,
 CASE WHEN req AND NOT src AND NOT alone THEN FALSE WHEN req AND src AND NOT mark THEN FALSE ELSE txt END AS success FROM o""")
def step_outcome(spark, d):
    i = (F.col("event_id") * 7 + F.col("user_id")) % 64
    bit = [F.floor(i / (1 << k)) % 2 == 1 for k in range(6)]
    return table(spark, d, "events").select("event_id", *K.step_outcome(*bit))


URLS = "urls AS (SELECT page_id, ' ' || replace(replace(url, 'http', 'HTTP'), 'example', 'Example') || CASE page_id % 5 WHEN 0 THEN '?q=1#ws_call_id=7' WHEN 1 THEN '#part;' WHEN 2 THEN '?a=B#C).' WHEN 3 THEN ',.' ELSE '?' END AS u FROM pages UNION ALL SELECT -page_id, 'no url ' || page_id || '.' FROM pages)"


@query("x31_canonical_urls", f"""WITH {URLS}, c AS (SELECT page_id, regexp_replace(trim(u), '[.,;:!?]+$', '') AS c FROM urls),
p AS (SELECT page_id, c, regexp_extract(c, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', ['scheme', 'host', 'path', 'query', 'fragment']) AS x FROM c)
SELECT page_id, CASE WHEN x.scheme = '' THEN c ELSE lower(x.scheme) || '://' || lower(x.host) || x.path || CASE WHEN x.query <> '' THEN '?' || x.query ELSE '' END || CASE WHEN x.fragment <> '' AND NOT starts_with(x.fragment, 'ws_call_id=') THEN '#' || x.fragment ELSE '' END END AS url FROM p""")
def canonical_urls(spark, d):
    pages, k = table(spark, d, "pages"), F.col("page_id") % 5
    end = F.when(k == 0, "?q=1#ws_call_id=7").when(k == 1, "#part;").when(k == 2, "?a=B#C).").when(k == 3, ",.").otherwise("?")
    u = pages.select("page_id", F.concat(F.lit(" "), F.replace(F.replace("url", F.lit("http"), F.lit("HTTP")), F.lit("example"), F.lit("Example")), end).alias("u"))
    u = u.unionByName(pages.select((-F.col("page_id")).alias("page_id"), F.concat(F.lit("no url "), F.col("page_id").cast("string"), F.lit(".")).alias("u")))
    return u.select("page_id", K.canonical_url(F.col("u")).alias("url"))


@query("x31_stripped_reports", rf"WITH {REPORTS} SELECT report_id, md5(CASE WHEN report_id % 2 = 0 THEN report ELSE regexp_replace(report, '\s*\[[1-9]\d*\]', '', 'g') END) AS digest FROM reports")
def stripped_reports(spark, d):
    return _reports(spark, d).select("report_id", F.md5(K.strip_unbacked(F.col("report"), F.col("report_id") % 2 == 0)).alias("digest"))
