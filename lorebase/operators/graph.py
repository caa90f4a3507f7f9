"""Entity graphs from contributions of documents; components; trees of spans and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.components import connected_components
from lorebase.operators.shared import written


def _saved(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    return written(df, "graph")


def adjacency(relations: DataFrame) -> DataFrame:
    """(node, neighbour) in both directions, once each, without loops."""
    both = relations.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(relations.select(F.col("target").alias("node"), F.col("source").alias("neighbour")))
    return both.where("node <> neighbour").distinct()


def components(relations: DataFrame) -> DataFrame:
    """(node, component): each node's smallest reachable node; nodes without a link to another are left out."""
    edges = relations.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return connected_components(edges).select("node", F.col("root").alias("component"))


def canonical_entities(contributions: DataFrame) -> DataFrame:
    """(entity_id, name, n_docs): the non-empty name of the smallest document, and how many documents."""
    named = F.when(F.col("name") != "", F.col("doc_id"))
    return contributions.groupBy("entity_id").agg(F.min_by("name", named).alias("name"), F.count_distinct("doc_id").alias("n_docs"))


def relation_weights(contributions: DataFrame) -> DataFrame:
    """(source, target, weight, strongest, n): the weight of the smallest document, and the largest."""
    return contributions.groupBy("source", "target").agg(F.min_by("weight", "doc_id").alias("weight"), F.max("weight").alias("strongest"), F.count(F.lit(1)).alias("n"))


def tree_depths(nodes: DataFrame, most: int = 8) -> DataFrame:
    """(id, depth) of (id, parent): 0 for roots and orphans, at most ``most``.

    One join a level; it stops after ``most`` levels, where deeper nodes count the same.
    """
    known = nodes.select(F.col("id").alias("pid"))
    up = nodes.join(known, nodes["parent"] == known["pid"], "left").select("id", F.col("pid").alias("above"), F.when(F.col("pid").isNull(), 0).otherwise(1).alias("depth"))
    step = up.select(F.col("id").alias("above"), F.col("above").alias("next"))
    for _ in range(most - 1):
        up = up.join(step, "above", "left").select("id", F.col("next").alias("above"), (F.col("depth") + F.when(F.col("next").isNotNull(), 1).otherwise(0)).alias("depth"))
    return up.select("id", F.least("depth", F.lit(most)).alias("depth"))


def preorder(nodes: DataFrame) -> DataFrame:
    """(tree, id, depth, position) of (tree, id, parent, start): parents before children, by start and id.

    A node's path holds start and id of all nodes above it; paths grow by one join a level
    until no node is left, and order the tree.  Nodes whose parent is not there are roots.
    """
    step = F.struct("start", "id")
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    n = _saved(nodes.join(known, ["tree", "parent"], "left").select("tree", "id", "start", F.when(F.col("known"), F.col("parent")).alias("parent")))
    level = _saved(n.where("parent IS NULL").select("tree", "id", F.array(step).alias("path")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        above = level.select("tree", F.col("id").alias("parent"), F.col("path").alias("above"))
        level = _saved(n.join(above, ["tree", "parent"]).select("tree", "id", F.concat("above", F.array(step)).alias("path")))
    every = reduce(DataFrame.unionByName, levels) if levels else level
    return every.select("tree", "id", (F.size("path") - 1).alias("depth"), F.row_number().over(Window.partitionBy("tree").orderBy("path")).cast("long").alias("position"))


def without_documents(contributions: DataFrame, gone: DataFrame) -> DataFrame:
    """(source, target, weight, doc_ids, n_docs): relations after documents are deleted, recomputed from what is left.

    A relation stays while one document contributes to it; its weight is the strongest of
    those that are left, its provenance the first hundred of their ids in order.  Rows are
    shuffled and sorted once by relation, where a document's rank counts the documents.
    """
    left = contributions.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    nth = F.dense_rank().over(Window.partitionBy("source", "target").orderBy("doc_id"))
    first = F.array_sort(F.collect_set(F.when(F.col("__r") <= 100, F.col("doc_id"))))
    return left.withColumn("__r", nth).groupBy("source", "target").agg(F.max("weight").alias("weight"), F.array_join(F.transform(first, lambda d: d.cast("string")), ",").alias("doc_ids"), F.max("__r").cast("long").alias("n_docs"))


def plan_waves(tasks: DataFrame) -> DataFrame:
    """(task, wave) of (task, deps): the longest way from a task without dependencies.

    One join a wave, until a wave holds no task.  What is then left is deadlocked and has a
    null wave: tasks on a cycle, with a dependency that is no task, or behind such a task.
    """
    waiting = _saved(tasks.select("task").distinct())
    edges = _saved(tasks.select("task", F.explode("deps").alias("dep")).distinct())
    waves, wave = [], 0
    while True:
        ready = _saved(waiting.join(edges.select("task").distinct(), "task", "left_anti"))
        if ready.isEmpty():
            break
        waves.append(ready.select("task", F.lit(wave).alias("wave")))
        waiting = _saved(waiting.join(ready, "task", "left_anti"))
        edges = _saved(edges.join(ready.select(F.col("task").alias("dep")), "dep", "left_anti"))
        if len(waves) >= 50:  # keeps the plan of the union short
            waves = [_saved(reduce(DataFrame.unionByName, waves))]
        wave += 1
    return reduce(DataFrame.unionByName, waves, waiting.select("task", F.lit(None).cast("int").alias("wave")))


def top_per(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
