"""Queries on payloads: tables are rendered as outside texts and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.plans.registry import query, table
from lorebase.sources import payloads as P


@query("s1_file_formats", "SELECT doc_id, CASE WHEN k = 5 THEN 'unsupported' WHEN n_chars > 6000 THEN 'too_large' WHEN doc_id % 9 = 0 THEN 'empty' WHEN length(text) > 3000 THEN 'too_long' END AS problem, ['pdf', 'docx', 'html', 'markdown', 'text', NULL][k + 1] AS format FROM (SELECT *, doc_id % 6 AS k FROM documents)")
def file_formats(spark, d):
    ends = F.array(*map(F.lit, (".PDF", ".docx", ".htm", ".md", ".txt", ".exe")))
    name = F.concat(F.lit("a.b/report "), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 6 + 1).cast("int")))
    text = F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", P.file_problem(name, F.col("n_chars"), text, 6000, 3000).alias("problem"), P.file_format(name).alias("format"))


@query("s2_decoded_texts", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'caf' || chr(233) || ' ' || doc_id END) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'latin-1' END AS encoding FROM documents")
def decoded_texts(spark, d):
    latin = F.encode(F.concat(F.lit("café "), F.col("doc_id").cast("string")), "ISO-8859-1")
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin).alias("content"))
    return P.read_texts(files).select(F.col("path").alias("doc_id"), F.md5("text").alias("digest"), "encoding")


@query("s17_span_lines", """SELECT user_id, event_id AS span_id, event_type AS name, event_id % 9 AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_id % 10 <> 0 QUALIFY position <= 50""")
def span_lines(spark, d):
    i = F.col("event_id")
    whole = F.concat(F.lit('{"span_id": '), i.cast("string"), F.lit(', "name": "'), "event_type", F.lit('", "tokens": '), (i % 9).cast("string"), F.lit("}"))
    lines = table(spark, d, "events").select("user_id", "ts", i, F.when(i % 10 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("line"))
    return P.span_lines(lines, "user_id", ["ts", "event_id"], 50)


@query("s22_model_catalogs", """WITH m AS (SELECT s_nationkey AS provider, s_suppkey AS pos, s_nationkey % 3 AS shape, CASE WHEN s_suppkey % 8 = 0 THEN ' ' ELSE 'Model ' || (s_suppkey % 40) END AS id, s_name AS owner FROM supplier),
f AS (SELECT provider, trim(id) AS id, CASE WHEN any_value(shape) = 2 THEN '' ELSE arg_min(owner, pos) END AS owner FROM m WHERE trim(id) <> '' GROUP BY ALL)
SELECT provider, id, owner, row_number() OVER (PARTITION BY provider ORDER BY lower(id), id) AS position FROM f QUALIFY position <= 5""")
def model_catalogs(spark, d):
    """Nations are providers: under data, under models, or a plain list of names."""
    name = F.when(F.col("s_suppkey") % 8 == 0, " ").otherwise(F.concat(F.lit("Model "), (F.col("s_suppkey") % 40).cast("string")))
    full = F.concat(F.lit('{"id": "'), name, F.lit('", "owned_by": "'), "s_name", F.lit('"}'))
    other = F.concat(F.lit('{"name": "'), name, F.lit('", "owner": "'), "s_name", F.lit('"}'))
    g = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("provider")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", full.alias("a"), other.alias("b"), F.concat(F.lit('"'), name, F.lit('"')).alias("c")))).alias("x"))
    text = lambda k: F.array_join(F.transform("x", lambda e: e[k]), ", ")
    shape = F.col("provider") % 3
    payload = F.when(shape == 0, F.concat(F.lit('{"data": ['), text("a"), F.lit("]}"))).when(shape == 1, F.concat(F.lit('{"models": ['), text("b"), F.lit("]}"))).otherwise(F.concat(F.lit(" ["), text("c"), F.lit("]")))
    return P.model_catalog(g.select("provider", payload.alias("payload")), 5)


@query("s19_search_results", "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'Other page' ELSE 'Page ' || page_id END AS title, CASE WHEN page_id % 3 = 1 THEN 'https://plain.org/' || page_id ELSE url END AS url, CASE WHEN page_id % 2 = 0 THEN 'about it' ELSE '' END AS content FROM pages WHERE page_id % 3 <> 2")
def search_results(spark, d):
    i = F.col("page_id")
    wrapped = F.concat(F.lit("//duckduckgo.com/l/?kh=1&amp;uddg="), F.url_encode("url"), F.lit("&amp;rut=x"))
    href = F.when(i % 3 == 0, wrapped).when(i % 3 == 1, F.concat(F.lit("https://plain.org/"), i.cast("string"))).otherwise("ftp://no.org/x")
    title = F.when(i % 3 == 1, "Other <b>page</b>").otherwise(F.concat(F.lit("Page "), i.cast("string")))
    html = F.concat(F.lit('<html><div class="result__body"><h2><a class="result__a" href="'), href, F.lit('">'), title, F.lit("</a></h2>"), F.when(i % 2 == 0, '<a class="result__snippet" href="#">about <i>it</i></a>').otherwise(""), F.lit('</div><div class="result__body">no link</div></html>'))
    return table(spark, d, "pages").select("page_id", F.explode(P.search_results(html, 5)).alias("r")).select("page_id", "r.*")


@query("s23_qa_blocks", """WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations)
SELECT conv_id, turn::INT AS number, 'asks ' || q AS question, CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' || chr(10) || 'more' END AS answer FROM t""")
def qa_blocks(spark, d):
    q = F.trim(F.regexp_replace("text", "\\s+", " "))
    block = F.concat(F.lit("### Q"), F.col("turn").cast("string"), F.lit("\n asks "), q, F.lit("\n\n**A:** "), F.when(F.col("turn") % 2 == 0, "yes ").otherwise("no\nmore"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("x"))
    text = F.concat(F.lit("Here:\n"), F.array_join(F.transform("x", lambda e: e["b"]), "\n"))
    return g.select("conv_id", F.explode(P.qa_blocks(text)).alias("b")).select("conv_id", "b.*")


@query("x28_bounded_scores", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 10.0 WHEN 2 THEN 0.0 ELSE round(least(10.0, greatest(0.0, value / 5)), 6) END::DOUBLE AS score FROM events")
def bounded_scores(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "none").when(k == 1, "99").when(k == 2, "-3.5").otherwise((F.col("value") / 5).cast("string"))
    return table(spark, d, "events").select("event_id", F.round(P.bounded_score(raw), 6).alias("score"))


@query("s11_scrolled_points", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2)")
def scrolled_points(spark, d):
    return P.scroll(table(spark, d, "embeddings"), F.col("label").isin(1, 2), ["vec_id", "label"], 100_000)
