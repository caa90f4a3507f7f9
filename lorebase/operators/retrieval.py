"""Lexical and vector search, fusion of rankings, reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import words
from lorebase.operators.shared import short_batches, written


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, term, tf) of batches of (id, words); terms are counted as numbers, a batch at a time."""
    for b in batches:
        ids, listed = b.columns
        sizes = pc.fill_null(pc.list_value_length(listed), 0)
        named = listed.flatten().dictionary_encode()
        at = np.repeat(np.arange(len(ids)), sizes.to_numpy(zero_copy_only=False)) * max(1, len(named.dictionary)) + named.indices.to_numpy(zero_copy_only=False)
        at, tf = np.unique(at, return_counts=True)
        row, term = np.divmod(at, max(1, len(named.dictionary)))
        for lo in range(0, len(at), 50_000):
            some = slice(lo, lo + 50_000)
            r = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([ids.take(r), sizes.take(r).cast(pa.int32()), named.dictionary.take(pa.array(term[some])), pa.array(tf[some], pa.int64())], ["id", "dl", "term", "tf"])


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, term, tf) of every row: terms are counted inside it, so nothing is shuffled.

    Rows of a repeated id are documents of their own; null texts have no terms.  Arrow batches are bounded in the
    session, and stay so, so that a Python worker never holds the words of thousands of documents.
    """
    short_batches(docs.sparkSession)
    w = docs.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    kind = dict(w.dtypes)["id"]
    return w.mapInArrow(term_counts, f"id {kind}, dl int, term string, tf long").withColumnRenamed("id", id_col)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, without: DataFrame | None = None, block: int = 8192) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` of :func:`bm25_scores`, which are never made as rows.

    Hits of the queries' terms and the queries are dealt to blocks, and each pair of blocks gives the ``k`` best of
    each query, so what is shuffled grows with documents and queries but not with their product.
    ``without`` (id) leaves documents out of the result, not out of the statistics.
    """
    given = queries.select("query_id", F.array_distinct(words(F.col("text"))).alias("terms"))
    asked = written(given.groupBy("query_id").agg(F.flatten(F.collect_list("terms")).alias("terms")).withColumn("q", F.monotonically_increasing_id()), "bm25-asked")
    q = asked.select("q", F.explode("terms").alias("term"))
    terms = written(q.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "bm25-terms")
    found = postings(docs, id_col, text_col).join(terms, "term").select(F.col(id_col).alias("id"), "dl", "t", "tf")
    hits = written(found, "bm25-hits")
    totals = docs.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size(words(F.coalesce(F.col(text_col), F.lit(""))))).alias("avgdl"))
    df = hits.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = q.join(terms, "term").join(df, "t").crossJoin(F.broadcast(totals)).select("q", "t", idf.alias("weight"))
    if without is not None:
        hits = hits.join(without.select("id").distinct(), "id", "left_anti")
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = hits.crossJoin(F.broadcast(totals)).select("id", "t", part.alias("x"))

    def best(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        held, out = TermColumns(a, "id"), []
        for of, g in q.groupby("q"):
            at, nth = held.hits(g["t"].to_numpy())
            s = np.bincount(held.row[at], g["weight"].to_numpy()[nth] * held.rows["x"].to_numpy()[at], minlength=len(held.ids))
            some = np.flatnonzero(s > 0)
            some = first_k(some, s[some], 6, k)
            out.append(pd.DataFrame({"q": of, "id": held.ids[some], "score": s[some]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "id": [], "score": []})

    near = by_blocks(rows, weights, docs.count(), asked.count(), block).applyInPandas(best, f"q long, id {dict(docs.dtypes)[id_col]}, score double")
    top = top_k(near, ["q"], [F.round("score", 6).desc(), F.col("id")], k)
    return top.join(asked.select("q", "query_id"), "q").select("query_id", F.col("id").alias(id_col), "score", "rank")


def block_counts(n_rows: int, n_asked: int, block: int, asking: int = 1024, most: int = 8192) -> tuple[int, int]:
    """Blocks of ids and blocks of queries.

    Rows are sent once for each block of queries, so with many blocks of ids, which keep all cores busy, blocks
    of queries hold more, ``most`` at most.
    """
    n_p = -(-n_rows // block) or 1
    return n_p, -(-n_asked // min(max(most, asking), asking * max(1, n_p // 8))) or 1


def by_blocks(rows: DataFrame, asked: DataFrame, n_rows: int, n_asked: int, block: int):
    """``rows`` (id, t, ...) and ``asked`` (q, t, ...), grouped by pairs of a block of ids and a block of queries."""
    n_p, n_q = block_counts(n_rows, n_asked, block)
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # both may come of one table of terms
    p = rows.withColumn("pb", F.pmod(F.xxhash64("id"), F.lit(n_p)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = asked.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))))
    return p.groupBy("pb", "qb").cogroup(q.groupBy("pb", "qb"))


class TermColumns:
    """Rows (id, t, ...) in order of their term's number t; ``row`` numbers their ids in order, null first."""

    def __init__(self, rows: pd.DataFrame, *ids: str):
        self.rows = rows.sort_values("t", ignore_index=True)
        self.terms = self.rows["t"].to_numpy()
        if len(ids) == 1:
            codes, named = pd.factorize(self.rows[ids[0]], sort=True)
            self.ids = np.append(np.array([None], object), np.array(named, object))
            self.row = codes + 1
        else:
            self.row = self.rows.groupby(list(ids), dropna=False, sort=True).ngroup().to_numpy()

    def hits(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows of the ``wanted`` terms, and which of them each has."""
        lo, hi = np.searchsorted(self.terms, wanted, "left"), np.searchsorted(self.terms, wanted, "right")
        n = hi - lo
        return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(wanted)), n)


def first_k(at: np.ndarray, score: np.ndarray, places: int, k: int) -> np.ndarray:
    """The ``k`` of ``at`` with the greatest rounded scores, the smallest of equals."""
    low = -np.round(score, places)
    few = np.flatnonzero(low <= np.partition(low, k - 1)[k - 1]) if len(low) > k else np.arange(len(low))
    return at[few[np.lexsort((at[few], low[few]))][:k]]


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every document with a positive score.

    ``queries`` has query_id and text.  Document frequencies and lengths cover all of
    ``docs``.  Postings are counted inside each row and meet the query terms first, by a
    join that Spark broadcasts if it finds the terms small, so only hits are shuffled, and
    those by query and document rather than by term.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    p = postings(docs, id_col, text_col)
    totals = docs.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size(words(F.coalesce(F.col(text_col), F.lit(""))))).alias("avgdl"))
    hits = written(p.join(q.select("term").distinct(), "term"), "bm25-hits")  # read twice, and small beside the texts
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(q.join(df, "term"), "term").crossJoin(F.broadcast(totals))
    idf = F.ln(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", id_col).agg(F.sum(idf * part).alias("score")).where("score > 0")


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their exact place in their group, in which no task holds a whole group.

    Rows are dealt by ranges of (group, order) and written; the rows of a group in each range are counted,
    what the ranges before it hold is added up, and rows are numbered inside a range.
    """
    dealt = written(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    keys = ["__range", *by]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("__in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    held = counts.select(*[F.col(c).alias("__k" + c) for c in keys], ahead.alias("__ahead"))
    same = reduce(lambda a, b: a & b, [numbered[c].eqNullSafe(held["__k" + c]) for c in keys])
    return numbered.join(held, same).select(*rows.columns, (F.col("__in") + F.col("__ahead")).cast("long").alias(name))


def term_hits(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, id, term): which of ``terms`` occur anywhere in a text, in lower case; each text is scanned once for all of them.

    ``row`` tells rows of one id apart.  The terms are sent to every executor, so their number has to be bounded; so are
    Arrow batches, as in :func:`postings`.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low")).where("low IS NOT NULL")
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ahocorasick.Automaton()
        for n, term in enumerate(sent.value):
            trie.add_word(term, n)
        trie.make_automaton()
        for b in batches:
            at, term = [], []
            for n, low in enumerate(b.column("low").to_pylist()):
                there = {t for _, t in trie.iter(low)}
                at += [n] * len(there)
                term += [sent.value[t] for t in there]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("id").take(at), pa.array(term, pa.string())], ["row", "id", "term"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(scan, f"row long, id {kind}, term string")


def keyword_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 200_000) -> DataFrame:
    """(query_id, id, score) of every text that holds a query's term: share of the terms that occur anywhere in it.

    A term may lie inside a word.  Distinct terms of all queries are looked for in one scan
    of the texts, or in one for each ``block`` terms; hits are then joined to the queries.
    """
    q = queries.select("query_id", F.array_distinct(words(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    q = q.select("query_id", F.size("terms").alias("__n"), F.explode("terms").alias("term"))
    distinct = q.select("term").distinct()
    n = -(-distinct.count() // block) or 1
    hits = []
    for at in range(n):
        some = [r.term for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(n)) == at).collect()]
        if some:
            hits.append(term_hits(docs, some, id_col, text_col))
    if not hits:
        return docs.select(F.lit(None).cast(dict(queries.dtypes)["query_id"]).alias("query_id"), id_col, F.lit(0.0).alias("score")).where("false")
    found = reduce(DataFrame.unionByName, hits).join(q, "term").groupBy("query_id", "row", "id", "__n").agg(F.count(F.lit(1)).alias("__m"))
    return found.select("query_id", F.col("id").alias(id_col), (F.col("__m") / F.col("__n")).alias("score"))


def keyword_matches(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` of :func:`keyword_scores`."""
    return top_k(keyword_scores(docs, queries, id_col, text_col), ["query_id"], [F.round("score", 6).desc(), F.col(id_col)], k)


def exact_knn(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096, itself: bool = False) -> DataFrame:
    """(query_id, id, score, rank) by cosine; a query never finds the point of its own id, unless ``itself`` is set.

    Vectors that are null, empty or hold a null or a value that isn't finite are left out, and only vectors of one
    length meet.  Points and queries are dealt to blocks by hash.  Each pair of blocks is
    one matrix product whose ``k`` best a query go on, so what is shuffled after it is
    bounded by queries times blocks times ``k``.
    """
    sound = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    n_p = -(-points.count() // block) or 1
    n_q = -(-queries.count() // block) or 1
    p = points.where(sound(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("width"), F.pmod(F.xxhash64(id_col), F.lit(n_p)).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    q = queries.where(sound(vector_col)).select(F.col(id_col).alias("qid"), F.col(vector_col).alias("qv"), F.size(vector_col).alias("width"), F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))).alias("pb"), F.pmod(F.xxhash64(id_col), F.lit(n_q)).cast("int").alias("qb"))
    kind, asking = dict(points.dtypes)[id_col], dict(queries.dtypes)[id_col]

    def unit(v) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return x / (np.linalg.norm(x, axis=1)[:, None] + 1e-30)

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "score": []}
        if len(a) and len(b):
            s, ids = unit(b["qv"]) @ unit(a["v"]).T, a["id"].to_numpy()
            for r, qid in enumerate(b["qid"]):
                low = -np.round(s[r], 6)
                few = np.flatnonzero(low <= np.partition(low, k)[k]) if len(low) > k + 1 else np.arange(len(low))
                best = few[np.lexsort((ids[few], low[few]))]
                best = best[(ids[best] != qid) | itself][:k]
                out["query_id"] += [qid] * len(best)
                out["id"] += ids[best].tolist()
                out["score"] += s[r][best].tolist()
        return pd.DataFrame(out)

    keys = ["pb", "qb", "width"]
    near = p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(product, f"query_id {asking}, id {kind}, score double")
    return top_k(near, ["query_id"], [F.round("score", 6).desc(), F.col("id")], k)


def rrf(rankings: DataFrame, weights: dict[str, float], k: int, base: int = 60) -> DataFrame:
    """(query_id, id, score, best_source, rank) of (query_id, ranking, rank, id).

    An id counts once for each ranking, at its best rank; rankings without a weight weigh 1,
    and with a column ``weight`` each row brings its own; scores are divided by the query's largest.
    """
    own = [F.first("weight").alias("weight")] if "weight" in rankings.columns else []
    once = rankings.groupBy("query_id", "ranking", "id").agg(F.min("rank").alias("rank"), *own)
    weight = F.col("weight") if own else F.lit(1.0) if not weights else F.coalesce(F.element_at(F.create_map(*[x for r, w in weights.items() for x in (F.lit(r), F.lit(float(w)))]), F.col("ranking")), F.lit(1.0))
    fused = once.groupBy("query_id", "id").agg(F.sum(weight / (base + F.col("rank"))).alias("raw"), F.min("ranking").alias("best_source"))
    top = F.max("raw").over(Window.partitionBy("query_id"))
    scored = fused.withColumn("score", F.when(top > 0, F.col("raw") / top).otherwise(0.0))
    return top_k(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)


def rerank(candidates: DataFrame, k: int, cap: int = 100) -> DataFrame:
    """(query_id, id, score, rank) of (query_id, ordinal, id, logit): sigmoid of clamped logits.

    Candidates beyond ``cap`` are not scored; logits that are not finite score 0.
    """
    x = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("logit")))
    score = F.when(F.isnan("logit") | (F.abs("logit") == float("inf")) | F.col("logit").isNull(), 0.0).otherwise(1 / (1 + F.exp(-x)))
    return top_k(candidates.where(F.col("ordinal") <= cap).withColumn("score", score), ["query_id"], [F.round("score", 9).desc(), F.col("ordinal")], k)
