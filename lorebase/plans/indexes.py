"""Queries on kept indexes: built, updated, read again, rolled back and restored."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from lorebase.operators import indexing, keyword_index
from lorebase.operators.kept import Store
from lorebase.operators.shared import scratch_path
from lorebase.plans.registry import query, table
from lorebase.plans.retrieval import BM25, CHUNKS

TOP = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"


def _queries(spark, d):
    return table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def _shown(found):
    return found.rows.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("k10_kept_index", f"WITH {BM25} {TOP}")
def kept_index(spark, d):
    """An index of all documents, written, and searched from what was written."""
    path = scratch_path(spark, "keyword-index")
    keyword_index.build(spark, path, table(spark, d, "documents"))
    return _shown(keyword_index.search(spark, path, _queries(spark, d), 20))


@query("s12_updated_index", f"""WITH now AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN coalesce(source, '') || ' ' || lower(coalesce(text, '')) || ' ' || coalesce(lang, '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3),
{BM25.replace('FROM documents)', 'FROM now)')} {TOP}""")
def updated_index(spark, d):
    """An index after an upsert and a delete in segments of their own, and compacted halfway."""
    docs, path = table(spark, d, "documents").select("doc_id", "text", "source", "lang"), scratch_path(spark, "keyword-index")
    keyword_index.build(spark, path, docs)
    text = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.lower(F.coalesce("text", F.lit(""))), F.coalesce("lang", F.lit("")))
    keyword_index.upsert(spark, path, docs.where("doc_id % 5 = 1").select("doc_id", text.alias("text")))
    keyword_index.compact(spark, path)
    keyword_index.delete(spark, path, docs.where("doc_id % 7 = 3"))
    return _shown(keyword_index.search(spark, path, _queries(spark, d), 20))


@query("m2_kept_statistics", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE doc_id % 7 <> 3)
SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM t GROUP BY term""")
def kept_statistics(spark, d):
    """Document and corpus frequencies of an index, deleted documents left out, from its postings alone."""
    path = scratch_path(spark, "keyword-index")
    keyword_index.build(spark, path, table(spark, d, "documents"))
    keyword_index.delete(spark, path, table(spark, d, "documents").where("doc_id % 7 = 3"))
    return keyword_index.statistics(spark, path)


CENSUS = f"""
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(chunk_id, ',' ORDER BY chunk_id)) AS digest FROM chunks GROUP BY doc_id)
SELECT s.doc_id, s.status, substr(sha256(coalesce(shown, '')), 1, 24) AS content_id, coalesce(n, 0)::BIGINT AS n_chunks, coalesce(n, 0)::BIGINT AS n_alive, coalesce(n, 0)::BIGINT AS n_points, coalesce(n, 0)::BIGINT AS n_keyed, digest
FROM states s LEFT JOIN c USING (doc_id)"""
_HAS = "length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0"
DOCS = CHUNKS.replace("FROM documents", "FROM live")


class _Stopped(Exception):
    pass


def _stop_at(step):
    def before(now):
        if now == step:
            raise _Stopped

    return before


@query("m9_indexed_documents", f"""WITH kinds AS (SELECT doc_id, text, coalesce({_HAS}, false) AS has, doc_id % 12 = 1 AND doc_id % 11 <> 5 AND coalesce({_HAS}, false) AS restored FROM documents),
states AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'deleted' WHEN has OR doc_id % 4 = 1 THEN 'indexed' ELSE 'failed' END AS status,
    CASE WHEN doc_id % 4 = 1 AND NOT restored THEN coalesce(text, '') || ' again.' WHEN NOT has AND doc_id % 3 = 0 THEN ' ' ELSE text END AS shown FROM kinds),
live AS (SELECT doc_id, shown AS text FROM states WHERE status = 'indexed'),
{DOCS}, {CENSUS}""")
def indexed_documents(spark, d):
    """Batches over all tables: one that stops before its commit, one that replaces, one that empties, a delete, and a restore."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), scratch_path(spark, "documents-index")
    first = indexing.index_documents(spark, path, docs)
    changed = docs.where("doc_id % 4 = 1").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" again.")).alias("text"))
    with contextlib.suppress(_Stopped):
        indexing.index_documents(spark, path, changed, before=_stop_at("commit"))
    indexing.index_documents(spark, path, changed)
    indexing.index_documents(spark, path, docs.where("doc_id % 3 = 0").select("doc_id", F.lit(" ").alias("text")))
    indexing.delete_documents(spark, path, docs.where("doc_id % 11 = 5"))
    has = F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r"))) > 0
    indexing.restore_documents(spark, path, docs.where((F.col("doc_id") % 12 == 1) & (F.col("doc_id") % 11 != 5) & has), first.number)
    store = Store(spark, path)
    return indexing.census(store, store.current())
