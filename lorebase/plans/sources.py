"""Queries on payloads of searches, layout of pages, and calls of tools in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.plans.registry import query, table
from lorebase.sources import harvest, layout, tool_calls


@query("s20_harvested_sources", """WITH p AS (SELECT page_id, page_id::VARCHAR AS i, regexp_replace(url, '#.*$', '') AS u FROM pages WHERE page_id IS NOT NULL),
t AS (SELECT *, 'Intro [Doc ' || i || '](' || u || '/c) here.' AS b1, 'Bare http://other.example/' || i || ', and ' || u || '.' AS b2 FROM p)
SELECT page_id, 1::BIGINT AS index, 'Media ' || i AS title, u AS url, substr(b2, 1, 4000) AS content FROM t
UNION ALL SELECT page_id, 2, 'Doc ' || i, u || '/c', b1 FROM t
UNION ALL SELECT page_id, 3, '', 'http://late.example/' || i, '' FROM t""")
def harvested_sources(spark, d):
    """Payloads made of pages, nested to a depth of their own, with sources that repeat, upgrade titles, or aren't public."""
    p = table(spark, d, "pages").where("page_id IS NOT NULL").select("page_id", F.col("page_id").cast("string").alias("i"), F.regexp_replace("url", "#.*$", "").alias("u"))
    text = lambda *parts: F.concat(*[F.lit(x) if x not in ("i", "u") else F.col(x) for x in parts])
    leaf = lambda **f: F.to_json(F.struct(*[v.alias(k) for k, v in f.items()]))
    depth = (F.col("page_id") % 60).cast("int")
    first = leaf(title=F.lit("Web"), url=F.col("u"))
    second = leaf(media=text("Media ", "i"), url=text("u", "#ws_call_id=9"))
    third = leaf(uri=text("u", "/c"), title=F.lit(""))
    fourth = leaf(title=F.lit("hidden"), link=text("http://user:pw@inner.example/", "i"))
    fifth = leaf(url=text("http://late.example/", "i", "!"))
    payload = F.concat(F.lit('{"output": [{"type": "web_search_call", "action": {"sources": ['), first, F.lit(", "), second, F.lit("]}}, "), F.repeat(F.lit('[{"more": '), depth), F.lit("["), third, F.lit(", "), fourth, F.lit(", "), fifth, F.lit("]"), F.repeat(F.lit("}]"), depth), F.lit("]}"))
    said = text("Intro [Doc ", "i", "](", "u", "/c) here.\n\nBare http://other.example/", "i", ", and ", "u", ".")
    return harvest.harvested(p.select("page_id", payload.alias("payload"), said.alias("text")), 3, "page_id")


WORD_BOXES = r"""
w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) - 1 AS i FROM documents),
boxes AS (SELECT doc_id, word, i, i // 10 AS row, (i // 10) % 11 = 5 AS wide, (i % 10) // 5 AS side FROM w),
placed AS (SELECT *, (CASE WHEN wide THEN 10 + 50 * (i % 10) ELSE 10 + 600 * side + 50 * (i % 5) END)::DOUBLE AS x0, 14.0::DOUBLE * row + 30 * (row // 7) + 0.5::DOUBLE * (i % 3) AS top FROM boxes),
lines AS (SELECT doc_id, row, CASE WHEN wide THEN 0 ELSE side END AS part, min(x0) AS x0, min(top) AS top, max(x0) + 40 AS x1, max(top) + 10 AS bottom, string_agg(word, ' ' ORDER BY x0) AS content FROM placed GROUP BY ALL),
gaps AS (SELECT doc_id, x0, lead(x0) OVER (PARTITION BY doc_id ORDER BY x0) AS next FROM lines),
widest AS (SELECT doc_id, max(next - x0) AS gap, arg_max((x0 + next) / 2, (next - x0, -x0)) AS split FROM gaps WHERE next IS NOT NULL GROUP BY doc_id),
sided AS (SELECT l.*, gap, split, CASE WHEN l.x0 >= split THEN 2 WHEN l.x1 <= split THEN 1 ELSE 0 END AS col FROM lines l LEFT JOIN widest USING (doc_id)),
counted AS (SELECT *, count(*) OVER d AS n, count(*) FILTER (col = 1) OVER d AS n1, count(*) FILTER (col = 2) OVER d AS n2 FROM sided WINDOW d AS (PARTITION BY doc_id)),
ordered AS (SELECT *, CASE WHEN n < 4 OR gap < 72 OR n1 < 2 OR n2 < 2 THEN 0 ELSE col END AS c FROM counted),
behind AS (SELECT *, lag(bottom) OVER o AS pb, lag(x0) OVER o AS px, lag(x1) OVER o AS px1, row_number() OVER (PARTITION BY doc_id ORDER BY c, top, x0) AS k FROM ordered WINDOW o AS (PARTITION BY doc_id, c ORDER BY top, x0)),
marked AS (SELECT *, CASE WHEN pb IS NULL OR top - pb > 18 OR abs(x0 - px) > greatest(72, 0.45::DOUBLE * greatest(px1 - px, 1)) THEN 1 ELSE 0 END AS new FROM behind),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS block_no FROM marked)"""


@query("w16_page_blocks", f"""WITH {WORD_BOXES}
SELECT doc_id, block_no::BIGINT AS block_no, md5(string_agg(content, chr(10) ORDER BY k)) AS digest, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, count(*) AS n_lines FROM numbered GROUP BY doc_id, block_no""")
def page_blocks(spark, d):
    """The words of documents set in two columns, every eleventh line across both, with a gap after every seventh."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("i", "text"))
    row = F.floor(F.col("i") / 10)
    wide, side = row % 11 == 5, F.floor(F.col("i") % 10 / 5)
    x0 = F.when(wide, 10 + 50 * (F.col("i") % 10)).otherwise(10 + 600 * side + 50 * (F.col("i") % 5)).cast("double")
    top = (14.0 * row + 30 * F.floor(row / 7) + 0.5 * (F.col("i") % 3)).cast("double")
    boxes = w.select("doc_id", x0.alias("x0"), top.alias("top"), (x0 + 40).alias("x1"), (top + 10).alias("bottom"), "text")
    out = layout.page_blocks(boxes, "doc_id")
    return out.select("doc_id", "block_no", F.md5("content").alias("digest"), "x0", "top", "x1", "bottom", "n_lines")


@query("x33_tool_calls", """WITH c AS (SELECT conv_id, turn, trim(replace(regexp_replace(text, '[&<>|]', ' ', 'g'), chr(160), ' '), ' ' || chr(9) || chr(10) || chr(13)) AS t, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 60) AS said FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, trim(replace(said, '|', '/')) AS q FROM c)
SELECT conv_id, turn, md5(t || ' end') AS cleaned, 'textual-tool-1' AS id, 'search' AS name, md5(q) AS query, turn::BIGINT AS top_k, turn % 2 = 0 AS fresh FROM p
UNION ALL SELECT conv_id, turn, md5(t || ' end'), 'textual-tool-2', 'read <x>', NULL, NULL, NULL FROM p""".replace("\\\\s", "\\s"))
def found_tool_calls(spark, d):
    """Answers with two calls planted in them, entities and full-width bars and marks that never close included."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    t = F.trim(F.replace(F.regexp_replace("text", "[&<>|]", " "), F.lit(" "), F.lit(" ")), F.lit(" \t\n\r"))
    said = F.replace(F.substring(F.regexp_replace("text", "\\s+", " "), 1, 60), F.lit("|"), F.lit("/"))
    inside = F.replace(F.replace(F.replace(said, F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&amp;lt;")), F.lit(">"), F.lit("&amp;gt;"))
    mark = lambda s: F.lit(s.replace("<", "<｜|DSML|｜").replace("<｜|DSML|｜/", "</｜|DSML|｜"))
    call = F.concat(mark("<tool_calls>"), mark('<invoke name="search">'), mark('<parameter name="query" string="true">'), inside, mark("</parameter>"), mark('<parameter name="top_k" integer="true">'), F.col("turn").cast("string"), mark("</parameter>"), mark('<parameter name="fresh" boolean="true">'), F.when(F.col("turn") % 2 == 0, "Yes").otherwise("no"), mark("</parameter>"), mark("</invoke>"), mark("<invoke name='read &amp;lt;x&amp;gt;'>"), mark("<parameter name='never'>"), mark("</invoke>"), mark("</tool_calls>"))
    f = c.select("conv_id", "turn", tool_calls.tool_calls(F.concat(t, call, F.lit(" end"))).alias("f"))
    f = f.select("conv_id", "turn", F.md5("f.cleaned").alias("cleaned"), F.explode("f.calls").alias("c"))
    arg = lambda n: F.get_json_object("c.arguments", f"$.{n}")
    return f.select("conv_id", "turn", "cleaned", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.md5(arg("query")).alias("query"), arg("top_k").cast("long").alias("top_k"), arg("fresh").cast("boolean").alias("fresh"))
