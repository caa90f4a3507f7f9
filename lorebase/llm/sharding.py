"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import as_scan


@dataclass(frozen=True)
class Tree:
    """regions[r][k] is the list of (shard, weight) in rack k of region r.

    Every node's weight is the sum of the weights below it.
    """

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def of(n_shards: int, racks: int = 2, per_rack: int = 5, base: int = 40) -> Tree:
        """``n_shards`` shards of weight 1: the first ``base`` in regions of ``racks`` racks of ``per_rack``, the others grown one by one.

        With the same base, the tree of n + 1 shards is that of n shards grown, for every n
        from the base on, so one more shard only takes rows into itself.  A smaller table
        begins with fewer shards: keep their number as its base from then on.
        """
        ids = iter(range(n_shards))
        regions = []
        left = min(n_shards, base)
        while left:
            region = []
            for _ in range(racks):
                take = min(per_rack, left)
                if take:
                    region.append(tuple((next(ids), 1.0) for _ in range(take)))
                    left -= take
            regions.append(tuple(region))
        tree = Tree(tuple(regions))
        for _ in range(n_shards - base):
            tree = tree.grown()
        return tree

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, as the only leaf of a new region.

        A region that exists keeps its weight and so its draws: rows leave it only for the
        new region, which holds nothing but the new shard.  (In a region that exists, a new
        shard would raise the weights of its region and rack, and rows that come in from
        other regions would be dealt to its older racks as well.)
        """
        return Tree((*self.regions, (((self.n_shards, weight),),)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _draw(key: Column, seed: int, node: Column, weight: Column) -> Column:
    """-ln(u) / weight with u keyed by (seed, node, row): the smallest of siblings wins."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, key), 11)
    return -F.ln((h.cast("double") + 0.5) / float(1 << 53)) / weight


def _choose(key: Column, seed: int, children: Column) -> Column:
    """The child (struct id, node, weight) of ``children`` whose draw is smallest."""
    scored = F.transform(children, lambda c: F.struct(_draw(key, seed, c["node"], c["weight"]).alias("draw"), c["id"].alias("id")))
    return F.array_min(scored)["id"]


def _structs(rows: list[tuple[int, str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(node).alias("node"), F.lit(float(w)).alias("weight")) for i, node, w in rows])


def assign(key: Column, tree: Tree, seed: int = 7) -> Column:
    """The shard of ``key``: a weighted hash draw among regions, then racks, then shards.

    A draw depends on the key and on one child's name and weight only.  If the weight of a
    subtree rises, rows move only into it; if it falls, only out of it; the order of rows
    in every other subtree stays.  Nodes of weight 0 take no rows.
    """
    live = [(r, [(k, [x for x in rack if x[1] > 0]) for k, rack in enumerate(region)]) for r, region in enumerate(tree.regions)]
    live = [(r, [(k, rack) for k, rack in region if rack]) for r, region in live]
    live = [(r, region) for r, region in live if region]
    if not live:
        raise ValueError("the tree has no shard of positive weight")
    weigh = lambda rack: sum(w for _, w in rack)
    top = _structs([(n, f"region {r}", sum(weigh(rack) for _, rack in region)) for n, (r, region) in enumerate(live)])
    racks = F.array(*[_structs([(k, f"rack {r}/{k}", weigh(rack)) for k, rack in region]) for r, region in live])
    width = 1 + max(k for _, region in live for k, _ in region)
    by_rack = {n * width + k: (r, k, rack) for n, (r, region) in enumerate(live) for k, rack in region}
    shards = F.create_map(*[x for at, (r, k, rack) in by_rack.items() for x in (F.lit(at), _structs([(s, f"shard {r}/{k}/{s}", w) for s, w in rack]))])
    region = _choose(key, seed, top)
    # let-binding by a one-element array keeps each level's draw to one evaluation
    racked = F.transform(F.array(region), lambda r: r * F.lit(width) + _choose(key, seed, F.element_at(racks, r + 1)))
    return F.transform(racked, lambda at: _choose(key, seed, F.element_at(shards, at)))[0].cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, buckets: int = 1024, tree: Tree | None = None) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every row of ``docs``.

    The law is ``key``: doc_id and the tree decide.  size is the text's UTF-8 bytes plus 16
    (null text: 16).  Rows of one id, and all rows of a null id, share a shard.  slot counts
    a shard's rows from 0 without gaps in the order of a hash of id, text and place in the
    files, so rows of one id or of equal texts lie apart: rows are numbered within
    ``buckets`` hash ranges of a shard and moved up by the counts of the ranges before, so no
    shard, id or group of copies is ever sorted in one task.  An empty table gives an empty
    result; columns of the six names are replaced, any other is kept, whatever its name.
    """
    tree = tree or Tree.of(n_shards)
    docs = as_scan(docs, "shard-docs")
    given = [c for c in docs.columns if c.lower() not in {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}]
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.xxhash64(F.lit(seed), F.lit("slot"), key, text, F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    # a generated row, as no filter is then inferred from how shard and bucket are made
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("given"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.inline(F.array(F.struct(assign(key, tree, seed).alias("shard"), assign(key, tree.grown(), seed).alias("grown_shard"), F.pmod(F.shiftrightunsigned(hashed, 20), F.lit(buckets)).cast("int").alias("bucket")))),
        hashed.alias("order"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("order", "file", "row")
    numbered = rows.withColumn("nth", F.row_number().over(within)).join(starts, ["shard", "bucket"])
    return numbered.select(
        *[F.col("given").getField(c).alias(c) for c in given], "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"
    )
