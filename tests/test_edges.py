"""Cases that the tables don't hold: Han terms, cycles, nested pages, ragged vectors, restarts."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import chunking, citations, components, context, elements, extraction, graph, knowledge, memory, outcomes, planning, questions, records, retrieval, traces, versions
from lorebase.sources import pages, payloads
from lorebase.streaming import tables
from tests.llm.fixtures import union


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_han_terms(spark):
    t = "Spark 引用校验 and the 中 data_1"
    assert sorted(one(spark, T.citation_terms(F.col("t")), t=t)) == sorted(["spark", "data", "引用", "用校", "校验", "中"])
    assert sorted(one(spark, T.fact_terms(F.col("t")), t=t)) == sorted(["spark", "and", "the", "data_1", "引用", "用校", "校验", "中"])
    assert sorted(one(spark, T.query_terms(F.col("t")), t="C++ 和 Spark 区别 架构设计")) == sorted(["c++", "spark", "架构设计"])
    assert one(spark, T.coverage(T.query_terms(F.col("t")), F.lit("nothing")), t="?") == 1.0


def test_claims_end_at_han_marks(spark):
    r = spark.createDataFrame([(1, "甲乙丙[1]。other 甲乙\nlast [2] here! none")], "report_id int, report string")
    got = {(c["claim"], tuple(c["markers"])) for c in citations.claims(r).collect()}
    assert got == {("甲乙丙", (1,)), ("last  here", (2,))}
    s = spark.createDataFrame([(1, 1, "", "", "甲乙丙丁", False), (1, 2, "", "http://x", "", False)], "report_id int, index int, title string, url string, content string, native boolean")
    assert {(x["index"], x["issue"]) for x in citations.checked_markers(r, s).collect()} == {(1, None), (2, "insufficient_source_content")}
    assert one(spark, citations.strip_unbacked(F.col("t"), F.lit(False)), t="a [1] b [2](http://x) [0]") == "a b [2](http://x) [0]"


def test_policy_takes_the_first_rule(spark):
    rule = lambda **k: one(spark, context.exclusion_reason(*[F.lit(k.get(n, v)) for n, v in (("mode", "auto"), ("excluded", False), ("selected", False), ("expires", None), ("now", 5), ("kind", "message"), ("grounding", None), ("score", 0.0), ("kept", False))]))
    assert rule(excluded=True, mode="manual") == "user_excluded" and rule(mode="manual") == "not_selected"
    assert rule(expires=5) == "expired" and rule(kind="artifact", grounding="model_only") == "model_only"
    assert rule() == "low_relevance" and rule(kept=True) is None and rule(kind="summary") is None and rule(score=0.12) is None


def test_plans_with_cycles_and_bad_dependencies(spark):
    plan = lambda p, rows: [(p, t, "do " + t, "research", 5, deps) for t, deps in rows]
    rows = plan(1, [("a", []), ("b", ["a", "a"])]) + plan(2, [("a", ["b"]), ("b", ["a"])]) + plan(3, [("a", ["a"])]) + plan(4, [("a", ["z"])]) + plan(5, [("a", []), ("a", [])]) + plan(6, [(x, []) for x in "abcdef"])
    t = spark.createDataFrame(rows, "plan_id int, task_id string, description string, task_type string, priority int, deps array<string>")
    assert {r["plan_id"]: r["problem"] for r in planning.plan_problems(t).collect()} == {1: None, 2: "cycle", 3: "self_dependency", 4: "unknown_dependency", 5: "duplicate_id", 6: "too_many"}


def test_waves_by_plan_equal_joins_and_cost_no_join(spark):
    rows = [(1, "a", []), (1, "b", ["a"]), (1, "c", ["b", "a"]), (2, "a", ["b"]), (2, "b", ["a"]), (2, "c", []), (3, "x", ["gone"]), (3, "y", ["x"]), (4, "a", ["a"])] + [(5, f"t{i}", [f"t{i - 1}"] if i else []) for i in range(6)]
    t = spark.createDataFrame(rows, "plan_id int, task string, deps array<string>")
    deps = {(p, task): d for p, task, d in rows}
    want = {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "a"): None, (2, "b"): None, (2, "c"): 0, (3, "x"): None, (3, "y"): None, (4, "a"): None} | {(5, f"t{i}"): i for i in range(6)}
    for crowd in (64, 5, 0):  # all plans in rows, one by joins, all by joins
        got = planning.waves_by_plan(t, crowd)
        assert {(r["plan_id"], r["task"]): (r["wave"], r["deps"]) for r in got.collect()} == {k: (w, deps[k]) for k, w in want.items()}
    plan = planning.waves_by_plan(t)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_pruning_keeps_a_plan_that_would_be_empty(spark):
    t = spark.createDataFrame([(1, "a", []), (1, "b", ["a"]), (1, "end", ["b"]), (2, "end", []), (2, "x", ["end"]), (3, "end", [])], "plan_id int, task string, deps array<string>")
    got = {(r["plan_id"], r["task"]) for r in planning.pruned(t, F.col("task") == "end").collect()}
    assert got == {(1, "a"), (1, "b"), (2, "end"), (2, "x"), (3, "end")}


def test_preorder_of_orphans_and_ties(spark):
    n = spark.createDataFrame([(1, 1, None, 5), (1, 2, 1, 7), (1, 3, 1, 6), (1, 4, 3, 9), (1, 5, 99, 1), (1, 6, 1, 6)], "tree int, id int, parent int, start int")
    assert [r["id"] for r in graph.preorder(n).orderBy("position").collect()] == [5, 1, 3, 4, 6, 2]


def test_duplicate_roots_keep_the_richer_one(spark):
    r = spark.createDataFrame([("a", 1, 1000, 50.0, 1), ("a", 2, 1040, 51.0, 3), ("a", 3, 9000, 50.0, 1), ("b", 4, 1000, 50.0, 1), ("a", 5, 1000, 90.0, 9)], "label string, id long, start_ms long, duration_ms double, richness int")
    assert {x["id"] for x in traces.collapsed(r, 100, 10).collect()} == {2, 3, 4, 5}


@pytest.mark.parametrize("start_ms,duration_ms", [(100, 10), (100, 0), (0, 10), (7, 3)])
def test_chains_of_duplicate_roots_make_no_pairs(spark, start_ms, duration_ms):
    """Roots by brute force, at ends of cells and across corners too; a crowd of equal roots is no crowd of pairs."""
    rng = random.Random(start_ms)
    data = [(rng.choice("ab"), i, rng.randint(-300, 3000) // 3 * 3, rng.choice([rng.uniform(-50, 300), 10.0 * rng.randint(-3, 30)]), rng.randint(0, 4)) for i in range(400)]
    data += [("a", 1000, 5, None, 1), ("a", 1001, 5, float("nan"), 1), (None, 1002, 5, 1.0, 1), (None, 1003, 5, 1.0, 2), ("b", 1004, None, 1.0, 1)]
    near = lambda a, b: None not in (*a[:4], *b[:4]) and a[0] == b[0] and abs(a[2] - b[2]) <= start_ms and abs(a[3] - b[3]) <= duration_ms
    top = union(len(data), [(i, j) for i in range(len(data)) for j in range(i) if near(data[i], data[j])])
    groups = {}
    for r, t in zip(data, top, strict=True):
        groups.setdefault(t, []).append(r)
    best = {min(g, key=lambda r: (-r[4], r[2] or 0, r[1]))[1] for g in groups.values()}
    d = spark.createDataFrame(data, "label string, id long, start_ms long, duration_ms double, richness int")
    assert {x["id"] for x in traces.collapsed(d, start_ms, duration_ms).collect()} == best
    if start_ms == 100 and duration_ms:
        crowd = spark.range(20000).select(F.lit("a").alias("label"), "id", F.lit(5).cast("long").alias("start_ms"), F.lit(1.0).alias("duration_ms"), (F.col("id") % 5).alias("richness"))
        assert [x["id"] for x in traces.collapsed(crowd, start_ms, duration_ms).collect()] == [4]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain in order of its nodes, as cells along the time are, is one component after a round, not after one for each few nodes."""
    rounds, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or write(df, name))
    e = spark.range(150).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(200, 220).select("id", F.lit(230)))
    assert {(r["root"], r["count"]) for r in components.connected_components(e).groupBy("root").count().collect()} == {(0, 151), (200, 21)}
    assert rounds.count("cc-edges") <= 4


def test_the_best_of_a_chain_is_no_order_of_one_task(spark):
    """A label's roots may all be one chain; the richest, earliest, smallest of it is found by partial aggregates."""
    r = spark.range(3000).select(F.lit("a").alias("label"), "id", F.expr("id div 2").alias("start_ms"), F.lit(1.0).alias("duration_ms"), F.when(F.col("id") != 7, F.col("id") % 5).alias("richness"))
    out = traces.collapsed(r, 100, 10)
    assert [x["id"] for x in out.collect()] == [4]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_html_is_parsed():
    html = "<html><title>A &amp; B</title><nav>x<nav>y</nav>z</nav><p>one&nbsp;&lt;two</p><script>if (a<b) {}</script><div>three<header>no</div><p>four"
    assert pages.parse_html(html) == ("A & B", "A & B\none\xa0<two\nthree")
    assert pages.parse_html(None) == ("", "")


def test_references_without_a_semicolon_are_text():
    html = "<title>ver&amp</title><p>a &lt b &notit; &copy; &#38; &#x26 c&amp;lt; & d&"
    assert pages.parse_html(html) == ("ver&amp", "ver&amp\na &lt b &notit; © & &#x26 c&lt; & d&")


def test_knn_passes_over_unsound_vectors(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["id"]) for r in retrieval.exact_knn(p, p, 3).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def test_postings_count_inside_rows(spark):
    d = spark.createDataFrame([(1, "b a b"), (1, "a"), (2, ""), (3, None)], "doc_id int, text string")
    assert sorted((r["doc_id"], r["dl"], r["term"], r["tf"]) for r in retrieval.postings(d).collect()) == [(1, 1, "a", 1), (1, 3, "a", 1), (1, 3, "b", 2)]


def test_postings_bound_what_a_worker_holds(spark):
    """Words of thousands of documents never come to a Python worker in one batch."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        for c, v in (("Records", "10000"), ("Bytes", "64m")):
            spark.conf.set(f"spark.sql.execution.arrow.max{c}PerBatch", v)
        retrieval.postings(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_keyword_search_bounds_what_a_worker_holds(spark):
    """texts that are scanned for terms reach Python in bounded Arrow batches, whatever ran before."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        for c, v in (("Records", "10000"), ("Bytes", "64m")):
            spark.conf.set(f"spark.sql.execution.arrow.max{c}PerBatch", v)
        retrieval.term_hits(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ["a"], "doc_id", "text")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_keyword_blocks_agree(spark):
    d = spark.createDataFrame([(i, f"word{i} common") for i in range(9)], "doc_id int, text string")
    q = spark.createDataFrame([(i, f"ord{i} common") for i in range(9)], "query_id int, text string")
    key = lambda b: sorted(tuple(r) for r in retrieval.keyword_scores(d, q, block=b).collect())
    assert key(2) == key(1000) and len(key(2)) == 81


def test_semantic_chunks_with_a_passed_embedding(spark):
    d = spark.createDataFrame([(1, "One a. Two a!  Three b? Four b")], "doc_id int, text string")
    by_last = lambda s: F.when(s.contains("a"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    got = chunking.semantic_chunks(d, embed=by_last).orderBy("chunk_no").collect()
    assert [(r["chunk_start"], r["chunk_end"]) for r in got] == [(0, 15), (15, 30)]


def test_recall_gates(spark):
    f = spark.createDataFrame([(1, "spark join skew", "", 1.0, 0.0), (2, "spark " + " ".join(f"w{i}" for i in range(90)), "", 1.0, 0.0), (3, "other", "spark join", 0.5, 400.0)], "fact_id int, content string, task string, confidence double, age_days double")
    q = spark.createDataFrame([(1, "spark join")], "query_id int, query string")
    assert [r["fact_id"] for r in memory.recall_facts(f, q, 5).orderBy("rank").collect()] == [1, 3]


def test_versions_of_absent_and_repeated_keys(spark):
    old = spark.createDataFrame([(1, 2, "t", "active", False)], "conv_id int, version int, title string, status string, deleted boolean")
    want = spark.createDataFrame([(1, 2, "  ", None), (9, None, "x", None)], "conv_id int, expected int, title string, status string")
    now, refused = versions.update_conversations(old, want)
    assert now.first().asDict() == {"conv_id": 1, "version": 3, "title": "t", "status": "active", "deleted": False}
    assert [tuple(r) for r in refused.collect()] == [(9, "not_found")]
    e = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "s string, t string")
    assert versions.add_if_absent(e.limit(0), e, ["s", "t"]).count() == 2 and versions.add_if_absent(e.where("s = 'a'").limit(1), e, ["s", "t"]).count() == 2


def test_small_talk_and_queries(spark):
    kind = lambda t: one(spark, questions.small_talk(F.col("t")), t=t)
    assert kind("“你好！”") == "greeting" and kind("哈哈哈哈") == "reaction" and kind("好的。") == "acknowledgement" and kind("hi there friend") is None
    assert one(spark, questions.expanded_queries(F.col("t")), t="1. a\n\n 2: b \n3. \nfour. x\nfive") == ["a", "2: b", "four. x"]
    assert one(spark, questions.query_mode(F.col("t")), t="It is Procedural, not factual-ish") == "factual"


def test_tables_and_boxes(spark):
    rows = F.array(F.array(F.lit("a|b"), F.lit(None).cast("string")), F.array(F.lit(" "), F.lit("")), F.array(F.lit("x  y")))
    t = one(spark, elements.markdown_table(rows, 10))
    assert (t["markdown"], t["n_rows"], t["n_columns"]) == ("| a\\|b |  |\n| --- | --- |\n| x y |  |", 2, 2) and one(spark, elements.markdown_table(rows, 2)) is None
    assert one(spark, elements.bounding_box(F.array().cast("array<array<double>>"))) is None
    assert one(spark, elements.edge_clusters(F.array(*map(F.lit, (0.0, 20.0, 40.0, 60.0, 69.0))))) == 3


def test_payloads_that_are_broken(spark):
    p = spark.createDataFrame([(1, '{"data": null, "models": [{"model": "m"}, {"id": " "}]}'), (2, "not json"), (3, '["b", "A", "b"]')], "provider int, payload string")
    assert sorted((r["provider"], r["id"]) for r in payloads.model_catalog(p, 9).collect()) == [(1, "m"), (3, "A"), (3, "b")]
    assert one(spark, payloads.qa_blocks(F.col("t")), t="none") == []
    assert one(spark, payloads.bounded_score(F.col("t")), t="inf") == 0.0
    with pytest.raises(ValueError):
        payloads.scroll(spark.range(5), F.lit(True), ["id"], 4)


def test_records(spark):
    assert one(spark, records.public_url(F.col("t")), t="https://u:p@Host:80/a//?q#f") == "https://host:80/a"
    assert one(spark, records.public_url(F.col("t")), t="javascript:alert(1)") == ""
    assert one(spark, records.asset_key(F.col("t"), F.lit("a.png")), t="../abc") is None
    assert one(spark, records.redacted(F.col("t")), t="x ghp_abcdefgh1 y sk-1") == "x [REDACTED] y sk-1"


def test_communities_are_numbered_and_bounded(spark):
    rel = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21), (21, 22)], "source long, target long")
    got = {(r["entity_id"], r["community"]) for r in knowledge.communities(rel, 3).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (20, 1), (21, 1), (22, 1)}
    assert {r["entity_id"] for r in knowledge.communities(rel, 2, 1).collect()} == {1, 2, 3}


def test_report_without_headings(spark):
    r = spark.createDataFrame([(1, "plain"), (2, "x\n# Aa \n\n## Bb\ntext\n#### four")], "report_id int, report string")
    got = {(x["report_id"], x["section"], x["title"], x["content"]) for x in outcomes.report_sections(r).collect()}
    assert got == {(1, 0, "", "plain"), (2, 0, "Bb", "text\n#### four")}


def test_streams_go_on(spark, tmp_path):
    """A second run with the same home cuts only what came since, and keeps what was there."""
    d = spark.createDataFrame([(1, "s", "one two"), (2, "s", "three")], "doc_id long, source string, text string")
    d.write.parquet(str(tmp_path / "in"))
    home = str(tmp_path / "home")
    assert tables.indexed_chunks(spark, str(tmp_path / "in"), home).count() == 2
    spark.createDataFrame([(2, "s", "three"), (3, "t", "four")], d.schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r["doc_id"] for r in tables.indexed_chunks(spark, str(tmp_path / "in"), home).collect()) == [1, 2, 3]


def test_several_text_queries(spark):
    """The registered searches have one query at this size; here are several."""
    d = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(40)], "doc_id int, text string")
    q = spark.createDataFrame([(i, f"w{i} w{i + 3} zz") for i in range(6)], "query_id int, text string")
    got = retrieval.bm25(d, q, 5)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "doc_id")
    assert got.groupBy("query_id").count().count() == 6
    assert got.withColumn("r", F.row_number().over(w)).where("r <> rank").count() == 0


def test_entry_needs_no_session():
    """Queries are told before a session is there."""
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > len(e.oracle_sql()) > 200"], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)


def test_summary_trees(spark):
    """Clusters by brute force, levels until nothing is made, and a passed summary."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(d, n, [float(x) for x in rng.normal(size=3)] if n % 6 else None) for d in range(5) for n in range(3 + 4 * d)]
    got = {(r["doc_id"], r["n"]): r["cluster"] for r in extraction.clustered(spark.createDataFrame(data, "doc_id long, n long, v array<double>"), 0.5).collect()}
    for d in range(5):
        v, used = {n: np.array(x) if x else None for i, n, x in data if i == d}, {}
        for i in sorted(v):
            if i not in used:
                used[i] = i
                for j in sorted(v):
                    if j > i and j not in used and v[i] is not None and v[j] is not None and v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j]) + 1e-8) > 0.5:
                        used[j] = i
        assert {n: got[d, n] for n in v} == (used if len(v) > 3 else dict.fromkeys(v, 0))
    chunks = spark.createDataFrame([(1, n, t) for n, t in enumerate(["a a", "a a", "b b", "b b", "c c"])] + [(2, 0, "x")], "doc_id long, n long, text string")
    tree = extraction.summary_tree(chunks, summarise=lambda t: F.array_join(t, "+")).orderBy("doc_id", "level", "n").collect()
    assert [(r["doc_id"], r["level"], r["n"], r["n_children"], r["text"]) for r in tree] == [(1, 1, 0, 2, "a a+a a"), (1, 1, 2, 2, "b b+b b"), (1, 2, 0, 3, "a a+a a+b b+b b+c c")]


def test_json_in_text(spark):
    texts = ["[1, [2]]", "so: [1, [2] ] and [3]", "[1", "none", None, "x [oops] y"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r["x"] for r in d.select(extraction.first_json_list("t").alias("x")).collect()] == ["[1, [2]]", "[1, [2] ]", None, None, None, None]
    d = spark.createDataFrame([("{bad} {\"a\": {\"b\": 1}} {}",), ("}",), (None,)], "t string").coalesce(1)
    assert [r["x"] for r in d.select(extraction.first_json_object("t").alias("x")).collect()] == ['{"a": {"b": 1}}', None, None]


def test_clusters_of_documents_over_batches(spark):
    """Documents that begin and end anywhere in an Arrow batch, with and without vectors, are clustered as one by one."""
    rng = random.Random(3)
    data = [(None if d == 5 else d, n, rng.choice([None, *[[float(k == i) + 0.1 for k in range(4)] for i in range(4)]])) for d in range(40) for n in range(0, 2 * rng.choice([1, 3, 7, 30]), 2)]
    rng.shuffle(data)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = {(r["doc_id"], r["n"]): r["cluster"] for r in extraction.clustered(spark.createDataFrame(data, "doc_id long, n long, v array<double>"), 0.5).collect()}
            assert len(got) == len(data)
            for d in {d for d, _, _ in data}:
                one = sorted((n, v) for x, n, v in data if x == d)
                assert [got[d, n] for n, _ in one] == [one[k][0] for k in extraction.greedy_clusters([v for _, v in one], 0.5)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_clusters_are_streamed(spark):
    """F9, F16: no pandas group a document."""
    nodes = spark.createDataFrame([(1, 0, [1.0])], "doc_id long, n long, v array<double>")
    plan = extraction.clustered(nodes, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Pandas" not in plan


def test_chunked_texts_come_in_bounded_batches(spark):
    """texts that are cut reach Python in bounded Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    chunking.fixed_chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_claims_meet_what_they_share(spark):
    """each claim of an index is held against the terms that its claims share with the source, not against all; Han and Latin terms too."""
    text = "The Alpha beta [1]. Gamma delta epsilon [1]. 图数据库 引用 [1]. zeta [2]. [2]. alpha [1]"
    reports = spark.createDataFrame([(1, text)], "report_id long, report string")
    sources = spark.createDataFrame([(1, 1, "alpha", "u", "BETA gamma 数据库 图数 引用", False), (1, 2, "", "u", "..", False)], "report_id long, index int, title string, url string, content string, native boolean")
    df = citations.checked_markers(reports, sources)
    got = sorted((r["sentence"], r["index"], r["issue"]) for r in df.collect())
    no = "unsupported_claim"
    assert got == [(0, 1, None), (1, 1, no), (2, 1, None), (3, 2, no), (4, 2, no), (5, 1, None)]
    assert "array_intersect(array_distinct(flatten(" in df._jdf.queryExecution().optimizedPlan().toString()


def test_job_updates_are_not_sorted_with_their_texts(spark):
    jobs = spark.createDataFrame([(1, "running", 10.0, None, 1.5, False), (2, "completed", 10.0, "old", 1.5, False), (3, "queued", 10.0, None, 1.5, False)], "job_id int, status string, progress double, error string, seconds double, cancel boolean")
    updates = spark.createDataFrame([(1, 150.0, "x" * 3000, 2.00049, None, True), (2, None, None, None, None, True), (9, 1.0, "none", 1.0, "failed", True)], "job_id int, progress double, error string, seconds double, status string, cancel boolean")
    done = versions.update_jobs(jobs, updates)
    assert {tuple(r) for r in done.collect()} == {(1, "running", 100.0, "x" * 2000, 2.0, True), (2, "completed", 10.0, "old", 1.5, False), (3, "queued", 10.0, None, 1.5, False)}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_relations_without_documents_keep_no_map_of_documents(spark):
    rows = [(d, 1, 2, d / 1000) for d in range(130)] + [(3, 1, 2, 0.9), (5, 1, 2, 1.0), (None, 1, 2, 0.5), (5, 7, 8, 1.0)]
    left = graph.without_documents(spark.createDataFrame(rows, "doc_id int, source int, target int, weight double"), spark.createDataFrame([(5,), (5,)], "doc_id int"))
    kept = [d for d in range(130) if d != 5][:99]  # the document without an id is the first of the hundred
    assert [tuple(r) for r in left.select("source", "target", "weight", "doc_ids", "n_docs").collect()] == [(1, 2, 0.9, ",".join(map(str, kept)), 130)]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan) if "source" in k and "doc_id" in k]
