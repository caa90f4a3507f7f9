"""Embedding near-dedup by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import written
from lorebase.operators.components import connected_components
from lorebase.llm.simhash import merged


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows q, scales s and bounds e of unit rows ``x``: the norm of x - s q is at most e."""
    s = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / s[:, None]).astype(np.int8)
    e = np.linalg.norm(x - s[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12
    return q, s, e


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, step: int = 512):
    """Yield (i, j) index arrays of the pairs of unit rows with cosine >= threshold.

    The int8 product times both scales is off by at most |y| e_x + |x| e_y + e_x e_y.  Pairs
    out of reach by that bound are dropped, pairs above the threshold by it are taken, and
    only the others are computed in double precision.  Products of int8 rows are whole
    numbers below 2**24 for up to 1,040 dimensions, so float32 adds them without an error;
    beyond that the product runs in double precision.
    """
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    qy = qy.astype(kind).T
    for at in range(0, len(x), step):
        about = (qx[at : at + step].astype(kind) @ qy) * sx[at : at + step, None] * sy[None, :]
        off = (ex[at : at + step, None] + ey[None, :]) * (1 + 1e-6) + ex[at : at + step, None] * ey[None, :] + 1e-9
        i, j = np.nonzero(about + off >= threshold)
        near = about[i, j] - off[i, j] < threshold
        exact = np.ones(len(i), bool)
        exact[near] = np.einsum("ij,ij->i", x[at + i[near]], y[j[near]]) >= threshold
        yield at + i[exact], j[exact]


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98, tile: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Two rows link if their labels are equal and not null (``label_col=None``: any two rows)
    and the cosine of their vectors, in double precision, is at least ``threshold``.
    Vectors that are null, empty, zero, or hold a null or a value that is not finite link
    with nothing, as do rows with a null id, whose component is null; vectors of different
    lengths never link.  Rows of one id with different vectors are vectors of their own, each with its own links.  n_links counts the other rows linked directly, equal vectors
    included, so repeated rows count each other.  component_id is the smallest id that links
    reach; kept tells whether that is the row's own.  An empty table gives an empty result;
    other columns are not read.

    Equal vectors become one class with a count.  A label's classes are dealt to tiles of
    about ``tile`` rows by hash; each pair of tiles is one group, which returns the counts of
    links of its rows and stars of its components, never the pairs themselves.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(0)
    v = F.col(vector_col)
    good = F.col("__id").isNotNull() & F.col("__label").isNotNull() & v.isNotNull()
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda c: F.coalesce(c != 0, F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("__id"), label.alias("__label"), v.alias(vector_col))
    rows = rows.withColumn("__good", F.coalesce(good & fine, F.lit(False)))
    classes = rows.where("__good").groupBy("__label", F.col(vector_col).cast("array<double>").alias("__v")).agg(F.min("__id").alias("__rep"), F.count(F.lit(1)).alias("__n"))
    classes = written(classes.withColumn("__cid", F.monotonically_increasing_id()), "embedding-classes")
    sizes = classes.groupBy("__label", F.size("__v").alias("__dim")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("__tiles"))
    dealt = classes.withColumn("__dim", F.size("__v")).join(sizes, ["__label", "__dim"])
    own = F.pmod(F.xxhash64("__cid"), F.col("__tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("__tiles") - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j")))
    dealt = dealt.select("__label", "__dim", "__cid", "__n", "__v", own.alias("__own"), F.explode(pairs).alias("t"))
    dealt = dealt.select("__label", "__dim", F.col("t.i").alias("__i"), F.col("t.j").alias("__j"), "__own", "__cid", "__n", F.col("__v").cast("array<float>").alias("__v") if dict(vectors.dtypes)[vector_col] == "array<float>" else "__v")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__cid", kind="stable")
        x = np.stack(group["__v"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1)[:, None]  # no overflow or underflow in the norm
        x /= np.linalg.norm(x, axis=1)[:, None]
        cid, n, tile_of = group["__cid"].to_numpy(), group["__n"].to_numpy(), group["__own"].to_numpy()
        i, j = int(group["__i"].iloc[0]), int(group["__j"].iloc[0])
        mine = np.flatnonzero(tile_of == i)
        others = mine if i == j else np.flatnonzero(tile_of == j)
        count, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        if len(mine) and len(others):
            for p, r in tile_links(x[mine], x[others], threshold):
                p, r = mine[p], others[r]
                ahead = p < r if i == j else p != r
                p, r = p[ahead], r[ahead]
                np.add.at(count, p, n[r])
                np.add.at(count, r, n[p])
                label = merged(label, p, r)
        far, some = np.flatnonzero(label != np.arange(len(cid))), np.flatnonzero(count)
        stars = pd.DataFrame({"a": cid[far], "b": cid[label[far]], "n": 0})
        return pd.concat([stars, pd.DataFrame({"a": cid[some], "b": cid[some], "n": count[some]})])

    found = written(dealt.groupBy("__label", "__dim", "__i", "__j").applyInPandas(linked, "a long, b long, n long"), "embedding-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("__cid")).agg(F.sum("n").alias("__links"))
    roots = written(connected_components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("__cid"), "root"), "embedding-roots")
    least = classes.join(roots, "__cid").groupBy("root").agg(F.min("__rep").alias("__least"))  # one id may have several classes
    told = classes.join(counts, "__cid", "left").join(roots, "__cid", "left").join(least, "root", "left").select("__label", F.col("__v"), (F.col("__n") - 1 + F.coalesce("__links", F.lit(0))).alias("n_links"), F.coalesce("__least", "__rep").alias("component_id"))
    told = told.withColumnRenamed("__label", "__l")
    keyed = rows.withColumn("__key", F.when(F.col("__good"), F.col(vector_col).cast("array<double>")))
    out = keyed.join(told, (keyed["__key"] == told["__v"]) & (keyed["__label"] == told["__l"]), "left")
    component = F.when(F.col("__good"), F.col("component_id")).otherwise(F.col("__id"))
    out = out.select(F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
