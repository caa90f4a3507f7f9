"""An entity graph that is kept and grows: only what a batch of documents touches is computed again.

Tables of the store (see ``kept``): ``entity_rows`` and ``relation_rows`` hold what each
document said, by generation; ``documents`` names the generation of a document that counts;
``entities``, ``relations`` and ``members`` are what follows from them, in rows that are
only added, the last one of a key counting.  Earlier versions stay as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.operators.components import connected_components
from lorebase.operators.kept import Store, Version
from lorebase.operators.retrieval import term_hits, top_k
from lorebase.operators.shared import by_shuffle, drop_written, written


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("__r")).select(*keys, "__r.*")


def _said(store: Store, version: Version, name: str) -> DataFrame:
    """Rows of the generation that counts of each document."""
    named = _latest(store.read(version, "documents"), ["doc_id"]).select("doc_id", "generation")
    return store.read(version, name).join(by_shuffle(named), ["doc_id", "generation"], "left_semi")


def entities(store: Store, version: Version) -> DataFrame:
    """(entity_id, name, type, description, n_docs) of the entities that a document names."""
    return _latest(store.read(version, "entities"), ["entity_id"]).where("n_docs > 0").drop("at")


def relations(store: Store, version: Version) -> DataFrame:
    """(source, target, type, weight, n_docs) of the relations that a document states between two entities that are there."""
    there = entities(store, version).select("entity_id")
    rows = _latest(store.read(version, "relations"), ["source", "target", "type"]).where("n_docs > 0").drop("at")
    for end in ("source", "target"):
        rows = rows.join(by_shuffle(there.withColumnRenamed("entity_id", end)), end, "left_semi")
    return rows


def members(store: Store, version: Version) -> DataFrame:
    """(entity_id, root): the smallest entity that relations reach from each."""
    return _latest(store.read(version, "members"), ["entity_id"]).where("root IS NOT NULL").select("entity_id", "root")


def communities(store: Store, version: Version, least: int = 3, most: int = 500) -> DataFrame:
    """(entity_id, community): components of ``least`` entities or more, numbered from 0 by their smallest; the first ``most``."""
    m = members(store, version)
    first = m.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy("root").limit(most)
    number = (F.row_number().over(Window.orderBy("root")) - 1).cast("long")
    return m.join(first.select("root", number.alias("community")), "root").select("entity_id", "community")


def _canonical(rows: DataFrame) -> DataFrame:
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("doc_id"))), F.lit("")).alias(c)
    return rows.groupBy("entity_id").agg(first("name"), first("type"), first("description"), F.count_distinct("doc_id").alias("n_docs"))


def _weighed(rows: DataFrame) -> DataFrame:
    by_doc = rows.groupBy("source", "target", "type", "doc_id").agg(F.max("weight").alias("weight"))
    return by_doc.groupBy("source", "target", "type").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n_docs"))


def _nothing(step: str) -> None:
    """Called before each step."""


def update(spark: SparkSession, path: str, new_entities: DataFrame, new_relations: DataFrame, gone: DataFrame | None = None, before: Callable[[str], None] = _nothing) -> Version:
    """Take in what documents say, and forget the documents of ``gone`` (doc_id).

    new_entities: (doc_id, entity_id, name, type, description); new_relations: (doc_id,
    source, target, type, weight).  What a document said before is replaced by what it says
    now.  An entity's fields are the first of its documents, in their order, that aren't
    empty; a relation weighs as much as the strongest of its documents.  Rows with a null key
    are passed over; repeated rows count once; a document may name a relation whose ends no one names, which then
    waits for them.

    Computed again are the entities and relations that a document of the batch names or named, and
    the components that hold such an entity, an end of such a relation, or an entity related to one of them.  The facts of
    the version tell their number (``renewed``) beside that of all entities with a component (``placed``).
    """
    store = Store(spark, path)
    now = store.current()
    at = now.number + 1
    stamp = F.lit(at).cast("long")
    e = new_entities.where("doc_id IS NOT NULL AND entity_id IS NOT NULL").select("doc_id", "entity_id", "name", "type", "description", stamp.alias("generation"))
    r = new_relations.where("doc_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL").select("doc_id", "source", "target", "type", "weight", stamp.alias("generation"))
    before("documents")
    docs = e.select("doc_id", stamp.alias("generation")).unionByName(r.select("doc_id", stamp.alias("generation"))).distinct()
    if gone is not None:
        lost = gone.select("doc_id").where("doc_id IS NOT NULL").distinct().join(by_shuffle(docs), "doc_id", "left_anti")
        docs = docs.unionByName(lost.select("doc_id", F.lit(0).cast("long").alias("generation")))
    new = now.with_parts(entity_rows=store.write("entity_rows", e), relation_rows=store.write("relation_rows", r), documents=store.write("documents", docs.withColumn("at", stamp)))
    batch = store.read(Version(at, {"documents": new.tables["documents"][-1:]}), "documents").select("doc_id")
    batch = by_shuffle(batch, batch.count())
    before("entities")

    def touched(name: str, keys: list[str]) -> DataFrame:
        """Keys that the batch names, or its documents named before."""
        rows = store.read(Version(at, {name: new.tables[name][-1:]}), name).select(*keys)
        if now.number:
            rows = rows.unionByName(_said(store, now, name).join(batch, "doc_id", "left_semi").select(*keys))
        return written(rows.distinct(), "touched")

    def renewed(name: str, table: str, keys: list[str], combine: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        wanted = touched(name, keys)
        n = wanted.count()
        alive = combine(_said(store, new, name).join(by_shuffle(wanted, n), keys, "left_semi"))
        rows = wanted.join(by_shuffle(alive, n), keys, "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)).cast("long"))
        parts[table] = store.write(table, rows.withColumn("at", stamp))
        return wanted, n

    parts = {}
    some, n_some = renewed("entity_rows", "entities", ["entity_id"], _canonical)
    before("relations")
    keys, n_keys = renewed("relation_rows", "relations", ["source", "target", "type"], _weighed)
    new = Version(at, new.with_parts(**parts).tables, dict(new.facts))
    before("members")
    nodes = some.unionByName(keys.select(F.col("source").alias("entity_id"))).unionByName(keys.select(F.col("target").alias("entity_id"))).distinct()
    stated = written(relations(store, new).select("source", "target"), "graph-edges")
    named = by_shuffle(nodes, n_some + 2 * n_keys)
    of = lambda here, there: stated.join(named.withColumnRenamed("entity_id", here), here, "left_semi").select(F.col(there).alias("entity_id"))
    nodes = near = written(nodes.unionByName(of("source", "target")).unionByName(of("target", "source")).distinct(), "graph-near")  # a relation may have waited for its end
    if now.number:
        n = near.count()
        was = _latest(store.read(now, "members"), ["entity_id"]).where("root IS NOT NULL").select("entity_id", "root")
        roots = was.join(by_shuffle(near, n), "entity_id", "left_semi").select("root").distinct()
        nodes = written(near.unionByName(was.join(by_shuffle(roots, n), "root", "left_semi").select("entity_id")).distinct(), "graph-nodes")
    n = nodes.count()
    held = by_shuffle(nodes, n)
    edges = stated.join(held.withColumnRenamed("entity_id", "source"), "source", "left_semi")
    found = connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    there = entities(store, new).select("entity_id").join(held, "entity_id", "left_semi").withColumn("__there", F.lit(True))
    placed = nodes.join(by_shuffle(there, n), "entity_id", "left").join(by_shuffle(found.withColumnRenamed("node", "entity_id"), n), "entity_id", "left")
    placed = placed.select("entity_id", F.when(F.col("__there"), F.coalesce("root", "entity_id")).alias("root"), stamp.alias("at"))
    new = Version(at, new.with_parts(members=store.write("members", placed)).tables, dict(new.facts))
    new.facts.update(renewed=n, placed=members(store, new).count())
    drop_written(some, keys, near, nodes, stated)
    before("commit")
    return store.commit(new)


def graph_hits(queries: DataFrame, entity_rows: DataFrame, relation_rows: DataFrame, member_rows: DataFrame, k_entities: int = 5, k_communities: int = 3) -> DataFrame:
    """(query_id, kind, id, score): entities, communities and relations that a query's words lead to.

    queries: (query_id, text); entity_rows: (entity_id, name, description); relation_rows:
    (source, target, type, weight); member_rows: (entity_id, community).  A word that occurs in an
    entity's name counts 2, in its description 1; the best ``k_entities`` go on (ties by id),
    their scores as shares of the query's largest.  The communities of these, as they come up, are
    scored by the mean share of their members, members without a hit counting 0; the relations at either end of these by half their weight's share of the largest.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower(F.trim("text")), "\\s+"), lambda w: w != ""))).alias("term"))
    terms = [r.term for r in q.select("term").distinct().collect()]
    if not terms:
        return q.select("query_id", F.lit("entity").alias("kind"), F.lit("").alias("id"), F.lit(0.0).alias("score")).where("false")
    told = term_hits(entity_rows, terms, "entity_id", "name").withColumn("x", F.lit(2.0)).unionByName(term_hits(entity_rows, terms, "entity_id", "description").withColumn("x", F.lit(1.0)))
    scored = told.join(q, "term").groupBy("query_id", F.col("id").alias("entity_id")).agg(F.sum("x").alias("raw"))
    scored = scored.join(scored.groupBy("query_id").agg(F.max("raw").alias("top")), "query_id").select("query_id", "entity_id", (F.col("raw") / F.col("top")).alias("share"))
    scored = written(scored, "graph-scores")
    best = written(top_k(scored, ["query_id"], [F.col("share").desc(), F.col("entity_id")], k_entities), "graph-best")
    named = lambda prefix, *c: F.concat_ws("_", F.lit(prefix), *[F.col(x).cast("string") for x in c]).alias("id")
    rows = best.select("query_id", F.lit("entity").alias("kind"), named("entity", "entity_id"), F.col("share").alias("score"))
    led = best.join(member_rows, "entity_id").groupBy("query_id", "community").agg(F.min("rank").alias("rank"))
    led = top_k(led.withColumnRenamed("rank", "first"), ["query_id"], [F.col("first"), F.col("community")], k_communities)
    sizes = member_rows.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    hits = led.select("query_id", "community").join(scored.join(member_rows, "entity_id"), ["query_id", "community"]).groupBy("query_id", "community").agg(F.sum("share").alias("s"))
    rows = rows.unionByName(hits.join(sizes, "community").select("query_id", F.lit("community").alias("kind"), named("community", "community"), F.round(F.col("s") / F.col("n"), 4).alias("score")))
    ends = best.select("query_id", "entity_id")
    near = relation_rows.join(ends.withColumnRenamed("entity_id", "source"), "source").select("query_id", "source", "target", "type", "weight")
    near = near.unionByName(relation_rows.join(ends.withColumnRenamed("entity_id", "target"), "target").select("query_id", "source", "target", "type", "weight")).distinct()
    most = near.groupBy("query_id").agg(F.max("weight").alias("most"))
    share = F.when(F.col("most") > 0, F.round(F.col("weight") / F.col("most") * 0.5, 4)).otherwise(0.15)
    return rows.unionByName(near.join(most, "query_id").select("query_id", F.lit("relation").alias("kind"), named("rel", "source", "target", "type"), share.alias("score")))
