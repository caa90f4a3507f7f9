"""Facts and episodes that are recalled: terms, gates, freshness, categories, views under a budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import fact_terms, one_of
from lorebase.operators.retrieval import TermColumns, by_blocks, first_k
from lorebase.operators.shared import written

# Words that tell a fact's category, in the order of the rules, and its freshness.
CATEGORIES = [
    ("code", ["function", "class", "import", "def ", "return", "api"]),
    ("api", ["http", "endpoint", "request", "response", "route"]),
    ("concept", ["is a", "refers to", "defined as", "meaning"]),
    ("workflow", ["step", "workflow", "pipeline", "process", "first"]),
    ("preference", ["prefer", "like", "always", "never", "favorite"]),
]
VOLATILE = ["今天", "当前", "最新", "实时", "价格", "天气", "比分", "股价"]
TIME_SENSITIVE = ["版本", "政策", "法规", "标准", "市场", "趋势", "排名"]


def category(text: Column) -> Column:
    """A fact's category: the first rule with a word in the lower-case text, else general."""
    low = F.lower(text)
    return F.coalesce(*[F.when(one_of(low, words), name) for name, words in CATEGORIES], F.lit("general"))


def freshness(text: Column, now: Column) -> tuple[Column, Column]:
    """Freshness class and expiry: volatile for a day, time_sensitive for 30, else stable."""
    low = F.lower(text)
    volatile, sensitive = one_of(low, VOLATILE), one_of(low, TIME_SENSITIVE)
    kind = F.when(volatile, "volatile").when(sensitive, "time_sensitive").otherwise("stable")
    return kind, F.when(volatile, now + F.expr("INTERVAL 1 DAY")).when(sensitive, now + F.expr("INTERVAL 30 DAYS"))


def recall_facts(facts: DataFrame, queries: DataFrame, k: int, coverage: float = 0.5, similarity: float = 0.2, block: int = 8192) -> DataFrame:
    """(query_id, fact_id, score, rank): the k best facts of each query.

    facts: (fact_id, content, task, confidence, age_days), queries: (query_id, query).  A fact
    counts by its content's or its task's terms, whichever does better: overlap by query
    terms at least ``coverage``, overlap by the geometric mean of the term counts at least
    ``similarity``.  The score is similarity times confidence times a boost of recent facts.

    Facts that hold a query's term and the queries are dealt to blocks, and each pair of blocks gives
    the ``k`` best of each query, so what is shuffled doesn't grow with facts times queries.
    """
    q = queries.select("query_id", fact_terms(F.col("query")).alias("qt"))
    q = written(q.withColumn("q", F.monotonically_increasing_id()), "recall-asked")
    terms = written(q.select(F.explode("qt").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "recall-terms")
    asked = q.select("q", F.size("qt").alias("nq"), F.explode("qt").alias("term")).join(terms, "term").drop("term")
    fields = ["id", "confidence", "age_days", "nc", "nt"]
    hits = _fact_postings(facts).join(terms, "term").select(F.col("fact_id").alias("id"), *[F.col(c).cast("double").alias(c) for c in fields[1:]], "t", "in_content", "in_task")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        held, out = TermColumns(a, *fields), []
        of_fact = held.rows[fields].iloc[np.unique(held.row, return_index=True)[1]]
        conf, age, nc, nt = (of_fact[c].to_numpy(float) for c in fields[1:])
        inside = [held.rows[c].to_numpy(float) for c in ("in_content", "in_task")]
        for of, g in b.groupby("q") if len(a) else ():
            at, _ = held.hits(g["t"].to_numpy())
            nq, rows = float(g["nq"].iloc[0]), np.unique(held.row[at])
            c, t = (np.bincount(held.row[at], x[at], minlength=len(of_fact))[rows] for x in inside)
            near = lambda n, of: np.where(n > 0, n / np.sqrt(nq * np.maximum(1, of[rows])), 0.0)  # noqa: B023, E731
            sim = np.maximum(near(c, nc), near(t, nt))
            on = (np.maximum(c, t) / nq >= coverage) & (sim >= similarity)
            rows, sim = rows[on], sim[on]
            boost = 1.0 + np.maximum(0.0, 0.1 - np.fmax(0.0, age[rows]) / 300.0)
            score = np.fmin(1.0, sim * conf[rows] * boost)  # without a confidence 1, as least() passes over null
            rows, score = rows[few := first_k(np.arange(len(rows)), score, 9, k)], score[few]
            out.append(pd.DataFrame({"q": of, "fact_id": of_fact["id"].to_numpy()[rows], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "fact_id": [], "score": []})

    near = by_blocks(hits, asked, facts.count(), q.count(), block).applyInPandas(best, f"q long, fact_id {dict(facts.dtypes)['fact_id']}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "fact_id")
    hit = near.join(q.select("q", "query_id"), "q")
    return hit.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "fact_id", "score", "rank")


def _fact_postings(facts: DataFrame) -> DataFrame:
    f = facts.select("fact_id", "confidence", "age_days", fact_terms(F.col("content")).alias("ct"), fact_terms(F.col("task")).alias("tt"))
    f = f.select("fact_id", "confidence", "age_days", F.size("ct").alias("nc"), F.size("tt").alias("nt"), "ct", "tt", F.explode(F.array_union("ct", "tt")).alias("term"))
    return f.select("fact_id", "confidence", "age_days", "nc", "nt", "term", F.array_contains("ct", F.col("term")).alias("in_content"), F.array_contains("tt", F.col("term")).alias("in_task"))


def budget_fold(rows: DataFrame, by: str, order: list, text: str, total: int, each: int | None = None) -> DataFrame:
    """Adds taken: texts in order, cut at ``each`` and at what is left of ``total`` characters of a group."""
    cut = F.col(text) if each is None else F.substring(text, 1, each)
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(total) - F.coalesce(F.sum(F.length(cut)).over(w), F.lit(0))
    return rows.withColumn("taken", F.when(left > 0, F.substring(cut, F.lit(1), left.cast("int"))).otherwise(""))


def first_texts(rows: DataFrame, by: str, key: str, text: str, total: int, block: int = 1000) -> DataFrame:
    """The rows with which the texts of a group, in order of ``key``, begin to fill ``total`` characters, and taken, what of each is used.

    Lengths are summed by blocks of keys first, so only texts of blocks that the budget reaches are sorted.
    """
    at = F.floor(F.col(key) / block)
    sizes = rows.groupBy(F.col(by).alias("__by"), at.alias("__block")).agg(F.sum(F.length(text)).alias("__chars"))
    upto = Window.partitionBy("__by").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    near = sizes.withColumn("__ahead", F.coalesce(F.sum("__chars").over(upto), F.lit(0))).where(F.col("__ahead") < total).select("__by", "__block")
    few = rows.join(near, F.col(by).eqNullSafe(F.col("__by")) & (at == F.col("__block")), "left_semi")
    w = Window.partitionBy(by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    left = few.withColumn("__left", F.lit(total) - F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).where("__left > 0")
    return left.withColumn("taken", F.substring(F.col(text), F.lit(1), F.col("__left").cast("int"))).drop("__left")


def working_view(items: DataFrame, by: str, mandatory: str, score: str, importance: str, time: str, tie: str, most: int) -> DataFrame:
    """The ``most`` items of each group: mandatory ones first, then by relevance, importance and time."""
    w = Window.partitionBy(by).orderBy(F.desc(mandatory), F.desc(score), F.desc(importance), F.desc(time), tie)
    return items.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
