"""Small fixtures for edges that the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import bookkeeping, chunking, conversations, graph, retrieval


def test_chunks_cover_and_reconstruct(spark):
    docs = spark.createDataFrame([("a", "alpha beta gamma\n\ndelta epsilon"), ("b", ""), ("c", None), ("d", "x" * 40), ("e", "   ")], "doc_id string, text string")
    chunks = chunking.fixed_chunks(docs, size=12, overlap=4)
    got = {r["doc_id"]: r["content"] for r in chunking.reconstruct(chunks).collect()}
    assert got == {"a": "alpha beta gamma\n\ndelta epsilon", "d": "x" * 40}


def test_reconstruct_overlap(spark):
    c = spark.createDataFrame([("a", 0, 0, 6, "abcdef"), ("a", 1, 3, 9, "defghi")], "doc_id string, chunk_no int, chunk_start int, chunk_end int, content string")
    assert chunking.reconstruct(c).first()["content"] == "abcdefghi"


def test_rrf_shared_first(spark):
    r = spark.createDataFrame([(1, "vector", 1, "shared"), (1, "vector", 2, "v"), (1, "bm25", 1, "shared"), (1, "bm25", 2, "b"), (1, "bm25", 3, "shared")], "query_id int, ranking string, rank int, id string")
    rows = retrieval.rrf(r, {"vector": 0.5, "bm25": 0.5}, 10).orderBy("rank").collect()
    assert rows[0]["id"] == "shared" and rows[0]["score"] == 1.0
    assert rows[1]["score"] == pytest.approx(rows[2]["score"])


def test_cjk_terms(spark):
    row = spark.createDataFrame([("Spark 数据处理 a 中",)], "t string").select(F.array_sort(T.lexical_terms(F.col("t"))).alias("x")).first()["x"]
    assert row == sorted(["spark", "数据", "据处", "处理", "中"])


def test_budget_skips_and_goes_on(spark):
    c = spark.createDataFrame([(1, 1, "a" * 40), (1, 2, "b" * 400), (1, 3, "a" * 40), (1, 4, " "), (1, 5, "c" * 40)], "g int, o int, content string")
    got = [r["verdict"] for r in conversations.allocate_budget(c, "g", ["o"], 25).orderBy("o").collect()]
    assert got == ["selected", "budget_exceeded", "duplicate", "empty", "selected"]


def test_components_and_depths(spark):
    rel = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "source long, target long")
    assert {(r["node"], r["component"]) for r in graph.components(rel).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8)}
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id long, parent long")
    assert {(r["id"], r["depth"]) for r in graph.tree_depths(nodes).collect()} == {(1, 0), (2, 1), (3, 2), (4, 0)}


def test_citations_without_markers_or_sources(spark):
    r = spark.createDataFrame([(1, "no marker"), (2, "one [2] and [9]"), (3, "[1]")], "report_id int, report string")
    s = spark.createDataFrame([(1, 1), (2, 2), (2, 3)], "report_id int, index int")
    got = {x["report_id"]: (x["n_markers"], x["n_valid"], x["unused"], x["invalid"]) for x in bookkeeping.verify_citations(r, s).collect()}
    assert got == {1: (0, 0, "1", ""), 2: (2, 1, "3", "9"), 3: (1, 0, "", "1")}


def test_knn_excludes_itself_and_takes_ties_by_id(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = retrieval.exact_knn(p, p.where("vec_id = 2"), 2, block=2).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 3]


def test_entry_and_tests_survive_without_llm(tmp_path):
    """Without the corpus operators, their tests and the pipeline, the rest imports and its tests pass."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for folder in ("lorebase", "tests"):
        shutil.copytree(root / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'j3_bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != root]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(kept)}
    some = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-k", "a1_catalog or k1_document or rrf_shared"], cwd=tmp_path, env=env, timeout=300, capture_output=True, text=True)
    assert some.returncode == 0 and "3 passed" in some.stdout, some.stdout[-2000:]


def test_a_broken_import_of_the_corpus_operators_shows(tmp_path):
    """Only the absence of the package is passed over."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lorebase", tmp_path / "lorebase", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lorebase/llm").mkdir()
    (tmp_path / "lorebase/llm/__init__.py").touch()
    (tmp_path / "lorebase/llm/queries.py").write_text("import lorebase.llm.not_there\n")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, timeout=120, capture_output=True, text=True)
    assert done.returncode != 0 and "not_there" in done.stderr


def test_waves_of_deep_plans_and_deadlocks(spark):
    rows = [(0, [])] + [(i, [i - 1, max(0, i - 2)]) for i in range(1, 56)] + [(100, [101]), (101, [100]), (102, [101, 0]), (103, [999]), (104, None), (104, None)]
    got = graph.plan_waves(spark.createDataFrame(rows, "task int, deps array<int>")).collect()
    assert len(got) == 61
    assert {r["task"]: r["wave"] for r in got} == {i: i for i in range(56)} | {100: None, 101: None, 102: None, 103: None, 104: 0}
