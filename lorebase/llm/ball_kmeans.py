"""Ball k-means: exact k-means that compares a vector only with the centroids that can be nearer.

A cluster is a ball: its centroid and the largest distance of a member.  Two centroids are
neighbours if the ball reaches half the way between them.  A member nearer to its centroid
than half the way to the nearest neighbour is in the stable core and stays; the others lie in
annuli, the n-th of which is compared with the n nearest neighbours.  Vectors and centroids
are whole numbers, so every bound is exact and ties are told.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import drop_written, written

#: Components are below this, so that a squared distance of up to 512 of them fits a long.
LARGEST = 2**26


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``c``, all whole numbers.

    Small components go through one product in double precision, in which every sum is exact.
    """
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if int(top) ** 2 * 4 * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def neighbours(between: np.ndarray, reach: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers, squared distances) of each ball's neighbour centroids, nearest first.

    ``between`` has the squared distances of the centroids; ``reach`` a whole number at least as large as each ball's radius.
    """
    out = []
    for i, r in enumerate(reach):
        order = np.lexsort((np.arange(len(between)), between[i]))
        order = order[(order != i) & (between[i][order] <= min(4 * r * r, 2**63 - 1))]
        out.append((order, between[i][order]))
    return out


def assigned(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, number of neighbours compared) of rows that were in ``cluster``.

    A neighbour can be as near as the own centroid only if it is no farther from that than
    twice the row is; with equal distances the smaller number wins.
    """
    out, dist, compared = cluster.copy(), np.zeros(len(x), np.int64), np.zeros(len(x), np.int32)
    for i in np.unique(cluster):
        rows = np.flatnonzero(cluster == i)
        dist[rows] = own = squared(x[rows], centroids[i : i + 1])[:, 0]
        order, far = near[i]
        annulus = np.searchsorted(-(-far // 4), own, side="right")  # far <= 4 own, without overflow
        compared[rows] = annulus
        for n in np.unique(annulus[annulus > 0]):
            some = rows[annulus == n]
            relevant = np.sort(np.append(order[:n], i))
            d = squared(x[some], centroids[relevant])
            best = d.argmin(axis=1)
            out[some], dist[some] = relevant[best], d[np.arange(len(some)), best]
    return out, dist, compared


def _pass(centroids: np.ndarray, near: list | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns batches of (id, v, cluster); without neighbours, each row is compared with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            if near is None:
                d = squared(x, centroids)
                cluster = d.argmin(axis=1)
                dist, compared = d[np.arange(len(x)), cluster], np.full(len(x), len(centroids))
            else:
                cluster, dist, compared = assigned(x, b.column("cluster").to_numpy(zero_copy_only=False), centroids, near)
            yield pa.RecordBatch.from_arrays([b.column("id"), v, pa.array(cluster, pa.int32()), pa.array(dist, pa.int64()), pa.array(compared, pa.int32())], ["id", "v", "cluster", "distance", "compared"])

    return run


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared) of each vector kept.

    Kept are vectors of ``dim`` components, none null or not finite, each turned into the
    whole number ``floor(scale * x)``; a vector with a number of 2**26 or more in size is left out, as its
    distances need not fit a long.  The first centroids are the ``k`` vectors of the smallest
    SHA-256 of ``seed:id`` (ties by the vector; a null id counts as an empty text); fewer
    vectors give fewer clusters, an empty table an empty result.  Each round puts every
    vector to the nearest centroid, of equally near ones to the smaller number, and then
    moves centroids to the rounded-down means; a centroid without vectors stays where it is.
    A last pass assigns once more.  Repeated rows count as often as they come; other columns
    are not read.  compared is the number of neighbours that the last pass compared.

    The driver holds k centroids and k sums, never vectors.  A ball's radius is that of its
    members around the last centroid, and the way the centroid has moved since.
    """
    spark, x = vectors.sparkSession, F.col("v")
    kind = dict(vectors.select(F.col(id_col).alias("i")).dtypes)["i"]
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int"))
    sound = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * scale) < LARGEST - 1), F.lit(False)))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(sound).select("id", whole.alias("v"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r.v for r in kept.orderBy(mark, "v").limit(k).collect()]
    schema = f"id {kind}, v array<int>, cluster int, distance long, compared int"
    if not first:
        out = spark.createDataFrame([], schema).select(F.col("id").alias(id_col), "cluster", "distance")
        return out.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit(""), "compared": F.lit(0)})
    centroids, near, table, stats = np.array(first, np.int64), None, None, []
    for n in range(rounds + 1):
        rows = kept if table is None else table
        new = written(rows.mapInArrow(_pass(centroids, near), schema), "ball-kmeans")
        if table is not None:
            drop_written(table)
        table = new
        sums = F.array(*[F.sum(x[i].cast("long")) for i in range(dim)]) if n < rounds else F.lit(None)
        stats = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia"), F.max("distance").alias("radius"), sums.alias("sums")).collect()
        if n < rounds:
            old, reach = centroids, [0] * len(centroids)
            centroids = centroids.copy()
            for s in stats:
                centroids[s.cluster] = [t // s.n for t in s.sums]
                moved = int(squared(centroids[s.cluster : s.cluster + 1], old[s.cluster : s.cluster + 1])[0, 0])
                reach[s.cluster] = isqrt(s.radius) + isqrt(moved) + 2
            near = neighbours(squared(centroids, centroids), reach)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(s.cluster, s.inertia, digest[s.cluster]) for s in stats], "cluster int, cluster_inertia long, centroid_sha256 string")
    out = table.join(F.broadcast(told), "cluster").withColumn("inertia", F.lit(sum(s.inertia for s in stats)).cast("long"))
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
