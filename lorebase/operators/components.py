"""Connected components of an edge table, by hooking to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.operators.shared import by_shuffle, drop_written, written

#: Rows of a written table's file, about.
_ROWS = 100_000


def connected_components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """Return (node, root) for every node of ``edges`` (columns a, b of one type).

    ``root`` is the smallest node that links reach.  In each round every node hooks to its
    smallest neighbour and follows its new parents, ``jumps`` times before each look, until no
    node moves; each jump doubles the way, so a chain of n nodes takes log n of them.  The edges are then renamed
    by these parents; loops and repeated edges fall out.  A node that nothing hooked to has smaller
    neighbours only after the round, so nodes are halved in two rounds at most.
    Hub nodes only ever meet a partial
    aggregate or a join against a table with one row a node.  All tables stay distributed
    and are written in the shared folder, in as many files as their rows call for, as the
    edges shrink from round to round; an empty edge table gives an empty result.  A round of many edges
    sends none of them through the driver.
    Edges with a null end are ignored.
    """
    now = written(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "cc-edges",
    )
    found, first = None, 0
    while rows := now.count():
        first = first or rows
        save = lambda df, name: written(df.coalesce(1 + rows // _ROWS), name)  # noqa: B023, E731
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            now.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        parents = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up"))
        parents, moving = save(parents, "cc-parents"), True
        while moving:
            start = parents
            for _ in range(jumps):
                upper = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
                parents = parents.join(by_shuffle(upper, rows), "up").select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved"))
            moved = save(parents, "cc-jumped")
            moving = not moved.where("moved").isEmpty()
            drop_written(start)
            parents = moved.select("node", "up")
        left = parents.select(F.col("node").alias("a"), F.col("up").alias("pa"))
        right = parents.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        renamed = now.join(by_shuffle(left, rows), "a").join(by_shuffle(right, rows), "b").where("pa <> pb")
        after = save(renamed.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        drop_written(now)
        if found is None:
            found = parents.withColumnRenamed("up", "root")
        else:
            step = parents.select(F.col("node").alias("root"), F.col("up").alias("top"))
            before, found = found, written(found.join(by_shuffle(step, rows), "root", "left").select("node", F.coalesce("top", "root").alias("root")).coalesce(1 + first // _ROWS), "cc-found")
            drop_written(before, parents)
        now = after
    if found is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
