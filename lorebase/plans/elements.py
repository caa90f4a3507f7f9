"""Queries on page elements: an order is a document, its lines are elements with boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.operators import elements as E
from lorebase.plans.registry import query, table

ELEMENTS = """e AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page, CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'R' THEN 'table' ELSE 'image' END AS kind, CASE WHEN l_linestatus = 'F' THEN 'ocr' ELSE 'native_text' END AS method, CASE WHEN l_quantity > 5 THEN l_tax END AS confidence,
  CASE WHEN l_quantity < 48 THEN l_quantity * 7 END AS "left", CASE WHEN l_quantity < 48 THEN l_extendedprice END AS top, l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS reading_order, CASE WHEN l_partkey % 10 = 0 THEN '  ' ELSE repeat('x', (l_partkey % 40)::INT) || l_partkey END AS content FROM lineitem)"""


def _elements(spark, d):
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "R", "table").otherwise("image").alias("kind"),
        F.when(F.col("l_linestatus") == "F", "ocr").otherwise("native_text").alias("method"), F.when(q > 5, F.col("l_tax")).alias("confidence"), F.when(q < 48, q * 7).alias("left"), F.when(q < 48, F.col("l_extendedprice")).alias("top"),
        (F.col("l_linenumber") * 100 + nth).cast("long").alias("reading_order"), F.when(F.col("l_partkey") % 10 == 0, "  ").otherwise(F.concat(F.repeat(F.lit("x"), (F.col("l_partkey") % 40).cast("int")), F.col("l_partkey").cast("string"))).alias("content"),
    )


@query("a16_average_confidence", f"WITH {ELEMENTS} SELECT doc_id, round(avg(confidence), 6) AS confidence FROM e GROUP BY doc_id")
def average_confidence(spark, d):
    return _elements(spark, d).groupBy("doc_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"))


@query("a17_page_metrics", f"WITH {ELEMENTS} SELECT doc_id, page, count(*) AS n_elements, count(*) FILTER (kind = 'table') AS n_tables, count(*) FILTER (kind = 'image') AS n_images, count(*) FILTER (method = 'ocr') AS n_ocr, round(avg(confidence), 6) AS confidence FROM e GROUP BY ALL")
def page_metrics(spark, d):
    return E.page_metrics(_elements(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("a18_element_kinds", f"WITH {ELEMENTS} SELECT doc_id, kind, count(*) AS n FROM e GROUP BY ALL")
def element_kinds(spark, d):
    return _elements(spark, d).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("w17_assembled_pages", f"""WITH {ELEMENTS}, s AS (SELECT *, coalesce(sum(CASE WHEN trim(content) <> '' THEN length(content) + 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, top NULLS LAST, "left" NULLS LAST, reading_order, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
SELECT doc_id, reading_order, CASE WHEN trim(content) <> '' THEN b END::BIGINT AS begin, CASE WHEN trim(content) <> '' THEN b + length(content) END::BIGINT AS "end" FROM s""")
def assembled_pages(spark, d):
    return E.assembled(_elements(spark, d)).select("doc_id", "reading_order", "begin", "end")


@query("p19_edge_clusters", f"""WITH {ELEMENTS}, g AS (SELECT doc_id, list([1.0, "left"] ORDER BY "left") AS x FROM e WHERE "left" IS NOT NULL GROUP BY doc_id),
c AS (SELECT doc_id, len(x) AS n, list_reduce(x, lambda a, b: CASE WHEN b[2] - a[2] > 28 THEN [a[1] + 1, b[2]] ELSE a END)[1]::INT AS clusters FROM g) SELECT doc_id, clusters, n >= 6 AND clusters >= 3 AS is_table FROM c""")
def edge_clusters(spark, d):
    g = _elements(spark, d).where("left IS NOT NULL").groupBy("doc_id").agg(F.collect_list("left").alias("edges")).withColumn("clusters", E.edge_clusters(F.col("edges")))
    return g.select("doc_id", "clusters", ((F.size("edges") >= 6) & (F.col("clusters") >= 3)).alias("is_table"))


@query("p20_points_in_boxes", f"""WITH {ELEMENTS} SELECT a.doc_id, a.reading_order, count(*) > 0 AS inside FROM e a JOIN e b ON a.doc_id = b.doc_id AND b."left" IS NOT NULL AND a."left" BETWEEN b."left" - 40 AND b."left" + 40 AND a.top BETWEEN b.top - 9000 AND b.top + 9000 AND a.reading_order <> b.reading_order GROUP BY ALL""")
def points_in_boxes(spark, d):
    """Elements whose corner lies in the box around another element of the document."""
    e = _elements(spark, d)
    box = F.struct((F.col("left") - 40).alias("x0"), (F.col("top") - 9000).alias("top"), (F.col("left") + 40).alias("x1"), (F.col("top") + 9000).alias("bottom"), "reading_order")
    boxes = e.where("left IS NOT NULL").groupBy("doc_id").agg(F.collect_list(box).alias("boxes"))
    j = e.join(boxes, "doc_id").withColumn("others", F.filter("boxes", lambda b: b["reading_order"] != F.col("reading_order")))
    return j.select("doc_id", "reading_order", E.inside_any(F.col("left"), F.col("top"), F.col("others")).alias("inside")).where("inside")


@query("x17_bounding_boxes", "SELECT l_orderkey AS doc_id, count(*) AS n, round(sum(least(l_quantity, l_tax * 100, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 50 END)), 4) AS x0, round(sum(greatest(l_extendedprice, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END)), 2) AS bottom FROM lineitem GROUP BY 1")
def bounding_boxes(spark, d):
    """A point, and a box or another point, of each line."""
    f = lambda c: F.col(c).cast("double")
    more = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.array(f("l_tax") * 100, f("l_suppkey"), f("l_discount") * 50, f("l_partkey")))).otherwise(F.array(F.array(f("l_tax") * 100, f("l_suppkey"))))
    box = E.bounding_box(F.concat(F.array(F.array(f("l_quantity"), f("l_extendedprice"))), more))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), box.alias("b"))
    return b.groupBy("doc_id").agg(F.count("b").alias("n"), F.round(F.sum("b.x0"), 4).alias("x0"), F.round(F.sum("b.bottom"), 2).alias("bottom"))


@query("p18_native_tables", r"""SELECT doc_id, len(l)::INT AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '\S(?:\s{2,}|\t)\S')))::INT AS aligned, len(l) >= 3 AND len(list_filter(l, lambda x: regexp_matches(x, '\S(?:\s{2,}|\t)\S'))) >= 2 AS is_table FROM (SELECT doc_id, list_filter(string_split(CASE WHEN doc_id % 3 = 0 THEN replace(text, ', ', '   ') ELSE text END, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)""")
def native_tables(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(", "), F.lit("   "))).otherwise(F.col("text"))
    n, aligned = E.table_lines(text)
    return table(spark, d, "documents").select("doc_id", n.alias("n_lines"), aligned.alias("aligned"), E.looks_like_table(text).alias("is_table"))


@query("p17_route_reasons", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'ocr_required' END, CASE WHEN doc_id % 4 = 0 THEN 'embedded_visual' END, CASE WHEN regexp_matches(text || CASE WHEN doc_id % 5 = 0 THEN ' ∀x × y' ELSE '' END, '[±×÷\x{2200}-\x{22ff}\x{27c0}-\x{27ef}]') THEN 'formula_candidate' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents")
def route_reasons(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " ∀x × y").otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.array_join(E.route_reasons(text, F.col("n_chars") < 200, F.col("doc_id") % 4 == 0), ",").alias("reasons"))


@query("x16_markdown_tables", """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_quantity % 3 = 0 THEN ['part ' || l_partkey, '', NULL] WHEN l_quantity % 7 = 0 THEN [' ', NULL] ELSE ['a | ' || l_returnflag, l_linestatus || '   x'] END AS c FROM lineitem),
n AS (SELECT doc_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, list_transform(c, lambda x: replace(trim(regexp_replace(coalesce(x, ''), '\\s+', ' ', 'g')), '|', '\\|')) AS c FROM r),
k AS (SELECT doc_id, list(c ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t FROM n WHERE len(list_filter(c, lambda x: x <> '')) > 0 GROUP BY doc_id),
w AS (SELECT doc_id, t, list_max(list_transform(t, lambda r: len(r))) AS w, list_sum(list_transform(t, lambda r: len(r))) AS cells FROM k),
m AS (SELECT doc_id, w, t, list_transform(t, lambda r: '| ' || array_to_string(list_concat(r, CASE WHEN len(r) < w THEN [''] ELSE [] END), ' | ') || ' |') AS lines FROM w WHERE cells <= 12)
SELECT doc_id, lines[1] || chr(10) || '| ' || CASE w WHEN 2 THEN '--- | ---' ELSE '--- | --- | ---' END || ' |' || CASE WHEN len(lines) > 1 THEN chr(10) || array_to_string(lines[2:], chr(10)) ELSE '' END AS markdown, len(t)::INT AS n_rows, w::INT AS n_columns FROM m""")
def markdown_tables(spark, d):
    q = F.col("l_quantity")
    none = F.lit(None).cast("string")
    c = F.when(q % 3 == 0, F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.lit(""), none)).when(q % 7 == 0, F.array(F.lit(" "), none)).otherwise(F.array(F.concat(F.lit("a | "), "l_returnflag"), F.concat("l_linestatus", F.lit("   x"))))
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", c.alias("c")))).alias("r"))
    return r.select("doc_id", E.markdown_table(F.transform("r", lambda x: x["c"]), 12).alias("t")).where("t IS NOT NULL").select("doc_id", "t.*")


@query("p32_kept_metadata", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang,source' ELSE 'source' END AS keys FROM documents")
def kept_metadata(spark, d):
    m = F.map_concat(F.create_map(F.lit("source"), F.col("source"), F.lit("table_html"), F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.col("lang"), F.lit("table_cells"), F.col("text"))).otherwise(F.create_map().cast("map<string,string>")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(E.kept_metadata(m))), ",").alias("keys"))
