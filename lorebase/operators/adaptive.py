"""Retrieval that adapts to what a question asks for: routes by mode, searches, fusion, one final order.

All queries run in one plan: a strategy table says which searches a query takes part in and
how they weigh, and each search runs once, for its queries only, and for a text that several ask only once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import hash_embedding
from lorebase.operators.answers import with_answers
from lorebase.operators.questions import MODES, expanded_queries
from lorebase.operators.retrieval import bm25, exact_knn, rerank, rrf, top_k
from lorebase.operators.shared import written

# Mode, hypothetical passage, more queries, weight of vectors, weight of keywords, graph.
STRATEGIES = [
    ("factual", False, False, 0.7, 0.3, False),
    ("conceptual", True, False, 0.8, 0.2, False),
    ("comparative", True, True, 0.5, 0.5, False),
    ("procedural", False, True, 0.4, 0.6, False),
    ("analytical", True, True, 0.6, 0.4, False),
    ("graph", False, False, 1.0, 0.0, True),
]
_STRATEGY = "mode string, use_hyde boolean, use_multi_query boolean, vector_weight double, bm25_weight double, use_graph boolean"


def routed(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, text, mode) with the strategy of their mode; an unknown or null mode is factual."""
    table = queries.sparkSession.createDataFrame(STRATEGIES, _STRATEGY)
    known = F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise("factual")
    return queries.withColumn("mode", known).join(F.broadcast(table), "mode")


def _once(asks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``asks`` (query_id, text) with each text once, under the least of its ids; and (query_id, asked): which id stands for which."""
    once = written(asks.groupBy("text").agg(F.min("query_id").alias("query_id")), name)
    same = asks.join(once.select(F.col("text").alias("__text"), F.col("query_id").alias("asked")), F.col("text").eqNullSafe(F.col("__text")))
    return once, same.select("query_id", "asked")


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    points: DataFrame,
    passages: DataFrame | None = None,
    expansions: DataFrame | None = None,
    graph: Callable[[DataFrame], DataFrame] | None = None,
    excluded: DataFrame | None = None,
    embed: Callable[[Column], Column] = hash_embedding,
    logit: Callable[[Column, Column], Column] | None = None,
    final_k: int = 6,
    retrieval_k: int = 20,
    bm25_k: int = 20,
    most: int = 50,
) -> DataFrame:
    """(query_id, mode, rank, id, kind, score) of the ``final_k`` best hits of each query.

    queries: (query_id, text, mode); chunks: (id, doc_id, text); points: (id, doc_id, vector).
    passages and expansions: (digest, answer), what a model made of the queries' texts (see
    ``answers``); a query whose answer is missing, null or blank goes without that search, except that a query
    is its own only expansion then.  graph: gives (query_id, id, score, doc_ids) for the
    queries routed to it.  excluded: (doc_id) of documents switched off, left out before any search takes its
    best.  A hit of the graph stays if one of its documents is on; without documents it goes.

    Each search takes the best ``retrieval_k``, or twice ``final_k`` if that is more, ``most``
    at most.  Searches with vectors and with keywords are fused by rank with the weights of
    the mode.  Fused hits come first, then those of the graph; with ``logit`` (query text,
    hit text) up to 100 of them are scored anew, else they are ordered by score.
    """
    if not 1 <= final_k <= most:
        raise ValueError(f"final_k must be between 1 and {most}")
    k = min(most, max(retrieval_k, 2 * final_k))
    if excluded is not None:
        off = excluded.select("doc_id").distinct()
        off_ids, points = chunks.join(off, "doc_id", "left_semi").select("id"), points.join(off, "doc_id", "left_anti")
    q = written(routed(queries.select("query_id", "text", "mode")), "adaptive-queries")  # small, and read by every search
    points = points.select("id", "vector")
    dense, sparse = q.select("query_id", F.col("vector_weight").alias("weight")), q.select("query_id", F.col("bm25_weight").alias("weight"))

    def near(asks: DataFrame, name: str) -> DataFrame:
        once, same = _once(asks, "adaptive-texts")
        vectors = written(once.select(F.col("query_id").alias("id"), embed(F.col("text")).alias("vector")), "adaptive-vectors")
        best = exact_knn(points, vectors, k, "id", "vector", itself=True).withColumnRenamed("query_id", "asked")
        return best.join(same, "asked").join(dense, "query_id").select("query_id", F.lit(name).alias("ranking"), "rank", "id", "weight")

    rankings = [near(q.select("query_id", "text"), "vector")]
    if passages is not None:
        told = with_answers(q.where("use_hyde"), passages.select("digest", "answer")).select("query_id", F.trim("answer").alias("text"))
        rankings.append(near(told.where("text <> ''"), "hyde"))
    asks = q.select("query_id", F.lit(0).alias("nth"), "text")
    if expansions is not None:
        many = with_answers(q.where("use_multi_query"), expansions.select("digest", "answer"))
        lines = expanded_queries(F.coalesce("answer", F.lit("")))
        lines = F.when(F.size(lines) > 0, lines).otherwise(F.array("text"))
        more = many.select("query_id", F.posexplode(lines).alias("nth", "text")).select("query_id", (F.col("nth") + 1).alias("nth"), "text")
        asks = asks.unionByName(more)
    # one search for the queries and all their expansions
    keyed, same = _once(written(asks.select(F.struct("query_id", "nth").alias("query_id"), "text"), "adaptive-asks"), "adaptive-texts")
    # documents that are off count in the statistics, as the index holds them
    hits = bm25(chunks, keyed, max(k, bm25_k), "id", "text", without=off_ids if excluded is not None else None)
    hits = hits.withColumnRenamed("query_id", "asked").join(same, "asked")
    hits = written(hits.select("query_id.query_id", "query_id.nth", "rank", "id"), "adaptive-hits")
    direct, other = hits.where("nth = 0"), hits.where("nth > 0")
    rankings.append(direct.join(sparse, "query_id").select("query_id", F.lit("bm25").alias("ranking"), "rank", "id", "weight"))
    if expansions is not None:
        # hits of a query's expansions come one after the other
        sizes = other.groupBy("query_id", "nth").agg(F.max("rank").alias("n")).select("query_id", F.col("nth").alias("of"), "n")
        ahead = other.select("query_id", "nth").distinct().join(sizes, "query_id").where("of < nth").groupBy("query_id", "nth").agg(F.sum("n").alias("ahead"))
        placed = other.join(ahead, ["query_id", "nth"], "left").withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0)))
        rankings.append(placed.join(sparse, "query_id").select("query_id", F.lit("multi_query").alias("ranking"), "rank", "id", "weight"))
    every = rankings[0].select("query_id", "ranking", F.col("rank").cast("long").alias("rank"), "id", "weight")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "ranking", F.col("rank").cast("long").alias("rank"), "id", "weight"))
    fused = rrf(every, {}, k)
    found = fused.select("query_id", F.col("id").cast("string").alias("id"), "score", F.lit("hybrid").alias("kind"), F.col("rank").cast("long").alias("ordinal"))
    if graph is not None:
        led = written(graph(q.where("use_graph").select("query_id", "text")), "adaptive-graph")
        on = F.col("doc_ids")
        if excluded is not None:
            each = led.select("query_id", "id", F.explode("doc_ids").alias("doc_id")).join(off, "doc_id", "left_anti").select("query_id", "id").distinct()
            led = led.join(each, ["query_id", "id"], "left_semi")
        led = top_k(led.where(F.size(on) > 0), ["query_id"], [F.col("score").desc(), F.col("id")], 2 * k)
        found = found.unionByName(led.select("query_id", F.col("id").cast("string").alias("id"), "score", F.lit("graph").alias("kind"), (F.col("rank") + k).cast("long").alias("ordinal")))
    if logit is not None:
        texts = chunks.select(F.col("id").cast("string").alias("id"), F.col("text").alias("__hit"))
        scored = found.join(q.select("query_id", F.col("text").alias("__query")), "query_id").join(texts, "id", "left")
        nth = top_k(scored, ["query_id"], [F.col("ordinal")], 100)
        scored = nth.select("query_id", "id", "kind", F.col("rank").alias("ordinal"), logit(F.col("__query"), F.coalesce("__hit", F.col("id"))).alias("logit"))
        best = rerank(scored, final_k)
    else:
        best = top_k(found, ["query_id"], [F.round("score", 6).desc(), F.col("ordinal")], final_k)
    return best.join(q.select("query_id", "mode"), "query_id").select("query_id", "mode", F.col("rank").cast("long").alias("rank"), "id", "kind", F.round("score", 6).alias("score"))
