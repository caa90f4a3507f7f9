"""Passed functions and adaptive retrieval on small fixtures; ranks by ranges; one-scan keyword search."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lorebase.operators import adaptive, answers, memory, retrieval
from lorebase.operators.kept import Store
from lorebase.operators.shared import scratch_path


def _counting(path, fails=()):
    def call(texts):
        with open(path, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if any(t in fails for t in texts):
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    return call


def test_each_distinct_text_is_asked_once(spark, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",), ("b",)], "text string")
    path, log = scratch_path(spark, "answers"), tmp_path / "calls"
    got = answers.kept_answers(spark, path, texts, _counting(log), batch=2)
    assert {r["answer"] for r in got.collect()} == {"A", "B", ""} and sorted(log.read_text().split("\n")[:-1]) == ["", "a", "b"]
    more = texts.unionByName(spark.createDataFrame([("c",), ("d",)], "text string"))
    got = answers.kept_answers(spark, path, more, _counting(log, fails={"c"}), batch=1)
    told = {r["answer"]: r["error"] for r in got.collect()}
    assert told == {"A": None, "B": None, "": None, "D": None, None: "RuntimeError: no answer"}
    assert sorted(log.read_text().split("\n")[4 - 1 : -1]) == ["c", "d"]  # what is known isn't asked again
    got = answers.kept_answers(spark, path, more, _counting(log), batch=1)
    assert all(r["error"] is None for r in got.collect()) and log.read_text().split("\n")[-2] == "c"
    assert Store(spark, path).current().number == 3
    joined = answers.with_answers(more, got).collect()
    assert {(r["text"], r["answer"]) for r in joined} == {(t, t and t.upper() if t != "" else "") for t in ("a", "b", "", "c", "d", None)}


def test_answers_of_a_wrong_number_are_failures(spark):
    got = answers.asked(spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1), lambda texts: texts[1:]).collect()
    assert {r["error"] for r in got} == {"ValueError: 1 answers to 2 texts"} and {r["answer"] for r in got} == {None}


CHUNKS = "id string, doc_id string, text string"


def test_documents_that_are_off_come_up_nowhere(spark):
    chunks = spark.createDataFrame([("off-1", "off", "red fox relationships"), ("on-1", "on", "red fox"), ("on-2", "on", "a blue bird")], CHUNKS)
    embed = lambda t: F.array(F.when(F.lower(t).contains("fox"), 1.0).otherwise(0.1), F.when(F.lower(t).contains("bird"), 1.0).otherwise(0.2))
    points = chunks.select("id", "doc_id", embed(F.col("text")).alias("vector"))
    queries = spark.createDataFrame([(1, "red fox", "graph"), (2, "red fox", None), (3, "fox bird", "comparative"), (4, "", "nonsense")], "query_id long, text string, mode string")
    asked = []

    def graph(q):
        asked.append({r["query_id"] for r in q.collect()})
        rows = [("only-off", 0.95, ["off"]), ("shared", 0.8, ["off", "on"]), ("none", 0.9, [])]
        return q.crossJoin(spark.createDataFrame(rows, "id string, score double, doc_ids array<string>")).drop("text")

    off = spark.createDataFrame([("off",), ("off",)], "doc_id string")
    expansions = spark.createDataFrame([("fox bird", "1. fox\n2. bird\n3. \n4. more")], "text string, answer string").select(answers.digest(F.col("text")).alias("digest"), "answer")
    passages = spark.createDataFrame([("fox bird", " about a bird ")], "text string, answer string").select(answers.digest(F.col("text")).alias("digest"), "answer")
    got = adaptive.retrieve(queries, chunks, points, passages, expansions, graph, off, embed, final_k=6)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["id"], r["kind"]))
    assert asked == [{1}]
    assert set(by[1]) == {("on-1", "hybrid"), ("on-2", "hybrid"), ("shared", "graph")}
    assert {i for rows in by.values() for i, _ in rows} == {"on-1", "on-2", "shared"}
    assert by[2][0] == ("on-1", "hybrid") and {r["mode"] for r in got.where("query_id IN (2, 4)").collect()} == {"factual"}
    # on-2: first by passage (0.5) and by the second line (0.5), second by the question itself
    raw = {"on-1": 0.5 / 61 + 0.5 / 62 + 0.5 / 62 + 0.5 / 61, "on-2": 0.5 / 62 + 0.5 / 61 + 0.5 / 61 + 0.5 / 62}
    scores = {r["id"]: r["score"] for r in got.where("query_id = 3").collect()}
    assert scores.keys() == raw.keys() and all(abs(scores[i] - raw[i] / max(raw.values())) < 0.02 for i in raw)
    with pytest.raises(ValueError):
        adaptive.retrieve(queries, chunks, points, final_k=51)


def test_a_text_that_several_ask_is_searched_once(spark, monkeypatch):
    """All modes of a question share its searches, and each still gets its rows; a null text is one too."""
    sent = []
    monkeypatch.setattr(adaptive, "exact_knn", lambda p, q, *a, **k: sent.append(q.count()) or retrieval.exact_knn(p, q, *a, **k))
    monkeypatch.setattr(adaptive, "bm25", lambda d, q, *a, **k: sent.append(q.count()) or retrieval.bm25(d, q, *a, **k))
    chunks = spark.createDataFrame([("a", "1", "fox"), ("b", "1", "fox fox den"), ("c", "2", "owl den")], CHUNKS)
    points = chunks.select("id", "doc_id", F.array(F.lit(1.0), F.length("text").cast("double")).alias("vector"))
    q = spark.createDataFrame([(1, "fox", "factual"), (2, "fox", "factual"), (3, "den", "factual"), (4, None, "factual"), (5, None, None)], "query_id long, text string, mode string")
    embed = lambda t: F.array(F.lit(1.0), F.coalesce(F.length(t), F.lit(0)).cast("double"))
    by = {}
    for r in adaptive.retrieve(q, chunks, points, embed=embed).collect():
        by.setdefault(r["query_id"], set()).add((r["rank"], r["id"], r["score"]))
    assert sent == [3, 3]
    assert by[1] == by[2] and by[4] == by[5] and len(by[1]) == len(by[3]) == len(by[4]) == 3


def test_rows_are_sent_to_few_blocks_of_queries():
    """With few blocks of rows, blocks of queries are small, so that there are tasks enough; with many they are large."""
    assert retrieval.block_counts(50_000, 1500, 8192) == (7, 2)
    assert retrieval.block_counts(3_000_000, 92_000, 8192) == (367, 12)
    assert retrieval.block_counts(0, 0, 8192) == (1, 1)


def test_a_passed_scorer_orders_the_candidates(spark):
    chunks = spark.createDataFrame([("a", "1", "fox"), ("b", "1", "fox fox"), ("c", "2", "fox den")], CHUNKS)
    points = chunks.select("id", "doc_id", F.array(F.lit(1.0), F.lit(0.5)).alias("vector"))
    q = spark.createDataFrame([(1, "fox", "factual")], "query_id long, text string, mode string")
    got = adaptive.retrieve(q, chunks, points, embed=lambda t: F.array(F.lit(1.0), F.lit(0.5)), logit=lambda ask, hit: F.length(hit).cast("double"), final_k=2).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "c"]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_ranks_by_ranges(spark, n):
    draw = random.Random(n)
    data = [(draw.choice([1, 1, 1, 2, None]), draw.randint(0, 9) / 10, i) for i in range(n)]
    df = spark.createDataFrame(data, "g int, score double, id int")
    got = {r["id"]: r["rank"] for r in retrieval.ranked(df.repartition(5), ["g"], [F.col("score").desc(), F.col("id")]).collect()}
    want = {}
    for g in {g for g, _, _ in data}:
        for k, (_, i) in enumerate(sorted((-s, i) for h, s, i in data if h == g), 1):
            want[i] = k
    assert got == want


def test_keyword_search_scans_once(spark):
    docs = spark.createDataFrame([(1, "The Catalogue"), (1, "cat"), (2, None), (3, "dog"), (4, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(7, "CAT log"), (8, "dog"), (9, "?"), (10, None)], "query_id int, text string")
    for block in (1, 1000):
        got = sorted(tuple(r) for r in retrieval.keyword_scores(docs, queries, block=block).collect())
        assert got == [(7, 1, 0.5), (7, 1, 1.0), (8, 3, 1.0)]
    assert retrieval.keyword_scores(docs, queries.where("query_id > 8")).count() == 0


def test_vectors_that_are_not_finite_are_left_out(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 1.0]), (3, [0.9, 0.1]), (4, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    got = retrieval.exact_knn(p, p, 5).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(1, 3), (3, 1)} and all(r["score"] is not None for r in got)


@pytest.mark.parametrize("block", [3, 10_000])
def test_searches_by_blocks_keep_whole_results(spark, block):
    """The best by pairs of blocks are the best of all pairs: ties, repeated and missing ids, documents left out, many queries."""
    rng = random.Random(block)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.8)) % 50}" for _ in range(n))
    docs = spark.createDataFrame([(i % 37, text(rng.randint(0, 30))) for i in range(60)] + [(90, None), (91, "w1 w2"), (92, "w1 w2")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, text(4)) for i in range(9)] + [(3, "w1 other"), (20, None), (21, "nothing")], "query_id int, text string")
    off = spark.createDataFrame([(5,), (91,)], "id long")
    every = retrieval.bm25_scores(docs, queries).join(off.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")
    want = retrieval.top_k(every, ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], 5)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in rows.collect())
    assert key(retrieval.bm25(docs, queries, 5, without=off, block=block)) == key(want)
    terms = lambda t: set(re.findall("[a-z0-9_]+", t))
    facts = [(i, text(6), text(1), rng.random(), rng.uniform(-5, 60)) for i in range(50)]
    asked = [(i, text(3)) for i in range(8)]
    best = []
    for q, t in asked:
        qt, found = terms(t), []
        for i, content, task, sure, age in facts:
            n = [(len(qt & terms(x)), len(terms(x))) for x in (content, task)]
            sim = max(a / math.sqrt(len(qt) * max(1, b)) for a, b in n)
            if max(a for a, _ in n) / len(qt) >= 0.5 and sim >= 0.2:
                found.append((-round(min(1.0, sim * sure * (1.0 + max(0.0, 0.1 - max(0.0, age) / 300.0))), 9), i))
        best += [(q, r, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(found)[:4], 1)]
    got = memory.recall_facts(spark.createDataFrame(facts, "fact_id long, content string, task string, confidence double, age_days double"), spark.createDataFrame(asked, "query_id long, query string"), 4, block=block)
    assert sorted((r["query_id"], r["rank"], r["fact_id"], round(r["score"], 6)) for r in got.collect()) == best
