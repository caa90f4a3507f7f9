"""The kept graph against a full rebuild after random batches; hits of its search by hand."""

import random

import pytest

from lorebase.operators import kept_graph as K
from lorebase.operators import shared
from lorebase.operators.kept import Store
from lorebase.operators.shared import scratch_path

E = "doc_id long, entity_id string, name string, type string, description string"
R = "doc_id long, source string, target string, type string, weight double"


def _plain(said):
    """Entities, relations and roots of {doc: (entities, relations)}."""
    entities, relations = {}, {}
    for doc in sorted(said):
        for ident, *fields in said[doc][0]:
            kept = entities.setdefault(ident, [["", "", ""], set()])
            kept[1].add(doc)
            kept[0] = [k or f or "" for k, f in zip(kept[0], fields)]
        for s, t, kind, w in said[doc][1]:
            kept = relations.setdefault((s, t, kind), [0.0, set()])
            kept[0] = max(kept[0], w)
            kept[1].add(doc)
    relations = {k: v for k, v in relations.items() if k[0] in entities and k[1] in entities}
    up = {x: x for x in entities}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for s, t, _ in relations:
        a, b = top(s), top(t)
        up[max(a, b)] = min(a, b)
    return ({i: (*f, len(d)) for i, (f, d) in entities.items()}, {k: (w, len(d)) for k, (w, d) in relations.items()}, {x: top(x) for x in entities})


@pytest.mark.parametrize("seed", [1])
def test_updates_equal_a_full_rebuild(spark, seed):
    draw, said, path = random.Random(seed), {}, scratch_path(spark, "graph")
    store, saved = Store(spark, path), []
    for batch in range(3):
        new = {}
        for _ in range(12 if not batch else 2):
            doc, island = draw.randrange(30), draw.randrange(8)
            name = lambda: f"e{island}{draw.randrange(5)}"  # noqa: B023, E731
            ents = [(n, draw.choice(["", "name " + n]), draw.choice([None, "t"]), f"of {doc}") for n in sorted({name(), name(), name()})]
            new[doc] = (ents, [(name(), name(), "r", draw.randint(1, 9) / 10) for _ in range(2)])
        gone = draw.sample(range(30), 2) if batch else []
        rows = [(d, *e) for d, (es, _) in new.items() for e in es], [(d, *r) for d, (_, rs) in new.items() for r in rs]
        v = K.update(spark, path, spark.createDataFrame(rows[0], E), spark.createDataFrame(rows[1], R), spark.createDataFrame([(g,) for g in gone], "doc_id long"))
        said = {d: x for d, x in (said | new).items() if d not in gone or d in new}
        entities, relations, roots = _plain(said)
        assert {r["entity_id"]: tuple(r)[1:] for r in K.entities(store, v).collect()} == entities
        assert {tuple(r)[:3]: tuple(r)[3:] for r in K.relations(store, v).select("source", "target", "type", "weight", "n_docs").collect()} == relations
        assert {r["entity_id"]: r["root"] for r in K.members(store, v).collect()} == roots
        assert v.facts["placed"] == len(entities)
        saved.append((v.number, roots))
    assert v.facts["renewed"] < len(entities)  # whole islands were left alone
    for number, was in saved[:2]:  # copy on write: earlier versions read as they were
        assert {r["entity_id"]: r["root"] for r in K.members(store, store.current(number)).collect()} == was


def test_failure_and_empty_batches(spark):
    path = scratch_path(spark, "graph")
    store = Store(spark, path)
    none = spark.createDataFrame([], E), spark.createDataFrame([], R)
    K.update(spark, path, *none)
    K.update(spark, path, spark.createDataFrame([(1, "a", "A", "", ""), (1, "b", "B", "", ""), (None, "c", "", "", ""), (2, None, "", "", "")], E), spark.createDataFrame([(1, "a", "b", "r", 0.5), (1, "a", "x", "r", 0.5), (1, "a", None, "r", 1.0)], R))

    def stop(step):
        if step == "commit":
            raise RuntimeError(step)

    with pytest.raises(RuntimeError):
        K.update(spark, path, *none, gone=spark.createDataFrame([(1,)], "doc_id long"), before=stop)
    assert {r["entity_id"]: r["root"] for r in K.members(store, store.current()).collect()} == {"a": "a", "b": "a"}
    K.update(spark, path, spark.createDataFrame([(3, "x", "X", "", "")], E), none[1])
    assert {r["root"] for r in K.members(store, store.current()).collect()} == {"a"}  # the end that was missing has come
    K.update(spark, path, *none, gone=spark.createDataFrame([(1,), (9,)], "doc_id long"))
    assert {r["entity_id"]: r["root"] for r in K.members(store, store.current()).collect()} == {"x": "x"}
    assert K.communities(store, store.current(), 1).collect()[0]["community"] == 0


def test_graph_hits(spark):
    entities = spark.createDataFrame([("a", "Red fox", "lives in the wood"), ("b", "Wood", None), ("c", "Other", "red"), ("d", "None", "")], "entity_id string, name string, description string")
    relations = spark.createDataFrame([("a", "b", "in", 0.8), ("c", "d", "is", 0.4), ("d", "d", "x", 1.0)], "source string, target string, type string, weight double")
    members = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "entity_id string, community long")
    queries = spark.createDataFrame([(1, "red WOOD"), (2, "nothing"), (3, " ")], "query_id long, text string")
    got = {(r["query_id"], r["id"]): round(r["score"], 4) for r in K.graph_hits(queries, entities, relations, members, 2, 1).collect()}
    # a: red in the name 2, wood in the description 1; b: wood in the name 2; c: red in the description 1
    assert got == {(1, "entity_a"): 1.0, (1, "entity_b"): round(2 / 3, 4), (1, "community_0"): round((1 + 2 / 3) / 2, 4), (1, "rel_a_b_in"): 0.5}


def test_large_batches_are_not_broadcast(spark, monkeypatch):
    """No table of more than a few rows is broadcast, however few bytes Spark takes it for."""
    monkeypatch.setattr(shared, "FEW", 0, raising=False)
    said = spark.sparkContext._jsc.sc().listenerBus()
    runs = spark._jsparkSession.sharedState().statusStore()
    said.waitUntilEmpty()
    first, path = runs.executionsCount(), scratch_path(spark, "graph")
    ents = lambda *docs: spark.createDataFrame([(d, x, x, "t", "") for d, xs in docs for x in xs], E)
    rels = lambda *docs: spark.createDataFrame([(d, a, b, "r", 1.0) for d, (a, b) in docs], R)
    one = [(1, "ab"), (2, "bc"), (3, "de")]
    two = [(4, "ef"), (5, "gh")]
    K.update(spark, path, ents(*one), rels(*one))
    v = K.update(spark, path, ents(*two), rels(*two), spark.createDataFrame([(2,)], "doc_id long"))
    roots = {r["entity_id"]: r["root"] for r in K.members(Store(spark, path), v).collect()}
    assert roots == {"a": "a", "b": "a", "d": "d", "e": "d", "f": "d", "g": "g", "h": "g"}
    said.waitUntilEmpty()
    plans = runs.executionsList(first, 10_000)
    plans = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]
