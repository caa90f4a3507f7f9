"""Kept tables, the keyword index and indexing with rollback, against plain recomputation."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.operators import indexing, keyword_index, retrieval
from lorebase.operators.kept import Conflict, Store, Version
from lorebase.operators.shared import scratch_path

DOCS = "doc_id long, text string"


def _docs(spark, data):
    return spark.createDataFrame(data, DOCS)


def _texts(n, seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    # few documents are short: their terms weigh most
    return [(i, " ".join(draw.choice(vocabulary) for _ in range(3 if i % 40 == 0 else draw.randint(20, 400)))) for i in range(n)]


def _rows(df, key):
    return sorted((r["query_id"], r["rank"], r[key], round(r["score"], 6)) for r in df.collect())


def test_versions_are_whole(spark):
    store = Store(spark, scratch_path(spark, "kept"))
    assert store.current() == Version() and store.read(store.current(), "a") is None
    one = store.commit(store.current().with_parts(a=store.write("a", spark.range(3))))
    part = store.write("a", spark.range(5).withColumn("more", F.lit("x")))
    assert store.read(store.current(), "a").count() == 3  # written, but not committed
    two = store.commit(one.with_parts(a=part, b=store.write("b", spark.range(1))))
    assert store.read(two, "a").count() == 8 and store.read(two, "a").where("more IS NULL").count() == 3
    assert store.read(store.current(1), "a").count() == 3 and store.read(store.current(1), "b") is None
    with pytest.raises(Conflict):
        store.commit(one.with_parts(a=part))
    with pytest.raises(ValueError):
        store.current(7)
    orphan = store.write("a", spark.range(9))
    three = store.commit(two.with_parts(a=[store.write("a", spark.range(2))]))
    gone = store.sweep(keep=1)
    assert any(orphan.path in g for g in gone) and len(gone) == 3
    assert store.read(store.current(), "a").count() == 2 and store.read(three, "b").count() == 1
    assert store.sweep(keep=1) == []


def test_search_equals_bm25_and_passes_over_blocks(spark):
    data = _texts(400)
    docs, path = _docs(spark, data), scratch_path(spark, "index")
    keyword_index.build(spark, path, docs, block=8)
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w7"), (3, "nothing here"), (4, None), (5, "w1 W1 w1 w59")], "query_id long, text string")
    again = keyword_index.search(spark.newSession(), path, queries, 3)
    assert _rows(again.rows, "id") == _rows(retrieval.bm25(docs, queries, 3), "doc_id")
    read = {r["read"]: r["count"] for r in again.blocks.groupBy("read").count().collect()}
    assert read[False] > read[True]
    plan = again.rows._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "text" not in plan.split("ReadSchema")[-1]  # terms reach the scan, which reads no texts


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_a_new_index(spark, seed):
    draw = random.Random(seed)
    held = dict(_texts(60, seed))
    path = scratch_path(spark, "index")
    keyword_index.build(spark, path, _docs(spark, list(held.items())), block=4)
    queries = spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, "w7 new"), (3, "w5 w9")], "query_id long, text string")
    for n in range(3):
        new = {draw.randrange(80): " ".join(draw.choices(["w1", "w7", "new", "w9"], k=draw.randint(0, 30))) for _ in range(6)}
        keyword_index.upsert(spark, path, _docs(spark, list(new.items())), block=4)
        held |= new
        gone = draw.sample(sorted(held), 5)
        keyword_index.delete(spark, path, _docs(spark, [(g, "") for g in [*gone, 10**6]]))
        held = {k: v for k, v in held.items() if k not in gone}
        if n == 1:
            keyword_index.compact(spark, path, block=4)
        want = retrieval.bm25(_docs(spark, list(held.items())), queries, 10)
        assert _rows(keyword_index.search(spark, path, queries, 10).rows, "id") == _rows(want, "doc_id")
    left = keyword_index.search(spark, path, queries, 10, without=spark.createDataFrame([(k,) for k in list(held)[::2]], "id long"))
    assert not {r["id"] for r in left.rows.collect()} & set(list(held)[::2])
    counts = {}
    for text in held.values():
        for w in set(text.split()):
            counts[w] = counts.get(w, 0) + 1
    assert {r["term"]: r["df"] for r in keyword_index.statistics(spark, path).collect()} == counts


def test_index_of_awkward_tables(spark):
    queries = spark.createDataFrame([(1, "same word")], "query_id long, text string")
    path = scratch_path(spark, "index")
    assert keyword_index.search(spark, path, queries, 5).rows.count() == 0
    keyword_index.build(spark, path, _docs(spark, []))
    assert keyword_index.search(spark, path, queries, 5).rows.count() == 0
    rows = [(1, "word"), (1, "zword same"), (None, "word"), (2, None), (3, ""), (4, "same " * 5000)]
    keyword_index.upsert(spark, path, _docs(spark, rows))
    assert {r["id"] for r in keyword_index.search(spark, path, queries, 5).rows.collect()} == {1, 4}
    assert Store(spark, path).current().facts["docs"] == 4
    with pytest.raises(ValueError):
        keyword_index.build(spark, scratch_path(spark, "index"), _docs(spark, rows), most=2)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", indexing.STEPS)
def test_a_failure_at_any_step_leaves_the_version_before(spark, step):
    path = scratch_path(spark, "documents")
    store = Store(spark, path)
    indexing.index_documents(spark, path, _docs(spark, [(1, "old text. " * 90), (2, "stays."), (3, " ")]))
    queries = spark.createDataFrame([(1, "old new stays")], "query_id long, text string")
    state = lambda: (store.current(), sorted(map(tuple, indexing.census(store, store.current()).collect())), _rows(keyword_index.search(spark, path, queries, 9).rows, "id"))
    old = state()

    def stop(now):
        if now == step:
            raise Stopped

    with pytest.raises(Stopped):
        indexing.index_documents(spark, path, _docs(spark, [(1, "new text."), (4, "new too.")]), before=stop)
    assert state() == old
    if step == "commit":
        store.sweep()
        assert state() == old
        indexing.index_documents(spark, path, _docs(spark, [(1, "new text."), (4, "new too."), (2, ""), (None, "x")]))
        told = {r["doc_id"]: r for r in indexing.census(store, store.current()).collect()}
        assert {k: (r["status"], r["n_chunks"]) for k, r in told.items()} == {1: ("indexed", 1), 2: ("indexed", 1), 3: ("failed", 0), 4: ("indexed", 1)}
        assert all(r["n_chunks"] == r["n_alive"] == r["n_points"] == r["n_keyed"] for r in told.values())


def test_texts_are_cut_where_they_were_scanned(spark, monkeypatch):
    """A batch of new documents shuffles no text by id; of rows of one id the greatest text counts all the same. Postings hold numbers."""
    plans, write = {}, Store.write
    monkeypatch.setattr(Store, "write", lambda self, name, df: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(self, name, df))
    path = scratch_path(spark, "documents")
    store = Store(spark, path)
    docs = spark.createDataFrame([(1, "one " * 300), (2, "two."), (3, None)], DOCS).repartition(2)
    first = indexing.index_documents(spark, path, docs)
    assert "text" not in plans["catalog"] and plans["chunks"].count("Exchange") <= docs._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert "id:string" not in dict(store.read(first, "postings").dtypes)["docs"]
    second = indexing.index_documents(spark, path, spark.createDataFrame([(2, "two."), (2, "a"), (4, "x. y"), (4, "z"), (1, "less")], DOCS))
    told = {r["doc_id"]: (r["status"], r["n_chunks"], r["n_alive"], r["n_points"], r["n_keyed"]) for r in indexing.census(store, second).collect()}
    assert told == {1: ("indexed", 1, 1, 1, 1), 2: ("indexed", 1, 1, 1, 1), 3: ("failed", 0, 0, 0, 0), 4: ("indexed", 1, 1, 1, 1)}
    assert {(r["doc_id"], r["content"]) for r in indexing.alive(store, second, "chunks").collect()} == {(1, "less"), (2, "two."), (4, "z")}


def test_restore_and_delete(spark):
    path = scratch_path(spark, "documents")
    store = Store(spark, path)
    first = indexing.index_documents(spark, path, _docs(spark, [(1, "one " * 300), (2, "two.")]))
    was = {r["doc_id"]: tuple(r) for r in indexing.census(store, first).collect()}
    second = indexing.index_documents(spark, path, _docs(spark, [(1, "other."), (2, "two."), (5, "five.")]))
    assert store.read(Version(0, {"chunks": second.tables["chunks"][-1:]}), "chunks").select("doc_id").distinct().count() == 2  # 2 is unchanged
    indexing.delete_documents(spark, path, _docs(spark, [(2, ""), (77, "")]))
    gone = indexing.census(store, store.current()).where("doc_id = 2").first()
    assert gone["status"] == "deleted" and gone["n_alive"] == gone["n_points"] == gone["n_keyed"] == 0
    last = indexing.restore_documents(spark, path, _docs(spark, [(1, ""), (2, ""), (5, "")]), first.number)
    now = {r["doc_id"]: tuple(r) for r in indexing.census(store, last).collect()}
    assert now[1] == was[1] and now[2] == was[2] and now[5][1] == "deleted"
    assert sorted(map(tuple, indexing.census(store, store.current(second.number)).collect()))[0][3] == 1  # an earlier version still reads


def test_lists_of_blocks_are_made_where_their_texts_are(spark):
    """Blocks that go on over Arrow batches, documents without words, and several batches of lists; one block is held at a time."""
    rows = [(1, 10, ["a", "b", "a"]), (1, 11, ["b"]), (2, 12, []), (2, 13, ["c"] * 5), (3, 14, ["a"])]
    t = pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "id": [r[1] for r in rows], "words": pa.array([r[2] for r in rows], pa.list_(pa.string()))})
    for size in (1, 2, 5):
        got = [x for b in keyword_index._block_lists(iter(t.to_batches(size))) for x in b.to_pylist()]
        flat = sorted((x["block"], x["term"], x["n"], x["top_tf"], x["low_dl"], sorted((d["id"], d["tf"], d["dl"]) for d in x["docs"])) for x in got)
        assert flat == [(1, "a", 1, 2, 3, [(10, 2, 3)]), (1, "b", 2, 1, 1, [(10, 1, 3), (11, 1, 1)]), (2, "c", 1, 5, 5, [(13, 5, 5)]), (3, "a", 1, 1, 1, [(14, 1, 1)])]
