"""SimHash near-dedup by a segment-popcount embedding and a grid range-join."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import forget_kept, free_name, short_batches, written
from lorebase.operators.components import connected_components

#: A-Z to a-z; tab, line feed, vertical tab, form feed and carriage return to space.
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: A fingerprint has 16 segments of 4 bits; a segment's bit count is a coordinate from 0 to 4.
_LOW = 0x1111111111111111
#: The coordinates go to two halves, and each half to two quarters.
_HALF, _QUARTER = 0xFFFFFFFF, 0xFFFF


def _fingerprint(text: str | None, width: int, seed: int) -> int:
    """Bits that are set in over half of the shingles' XXH64; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a block of hashes at a time bounds the memory
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, __fp): the 64-bit SimHash of each whole text, as a signed long."""
    short_batches(docs.sparkSession)

    def hashed(batches):
        forget_kept()
        for b in batches:
            fp = [_fingerprint(t, width, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=[id_col, "__fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(hashed, f"`{id_col}` {kind}, __fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedded(fp: Column) -> Column:
    """The 16 segment bit counts in one long: a count of c is written as c ones in its four bits.

    So written, the Manhattan distance of two count vectors is the number of bits in which
    the longs differ.
    """
    low = lambda x: x.bitwiseAND(F.lit(_signed(_LOW)))
    b = [low(F.shiftrightunsigned(fp, k)) for k in range(4)]
    any01, all01, any23, all23 = b[0].bitwiseOR(b[1]), b[0].bitwiseAND(b[1]), b[2].bitwiseOR(b[3]), b[2].bitwiseAND(b[3])
    one, four = any01.bitwiseOR(any23), all01.bitwiseAND(all23)
    two = all01.bitwiseOR(all23).bitwiseOR(any01.bitwiseAND(any23))
    three = all01.bitwiseAND(any23).bitwiseOR(any01.bitwiseAND(all23))
    return one.bitwiseOR(F.shiftleft(two, 1)).bitwiseOR(F.shiftleft(three, 2)).bitwiseOR(F.shiftleft(four, 3))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embedded count vectors, never above the Hamming distance."""
    return F.bit_count(a.bitwiseXOR(b))


def _steps(v: Column, segments: range) -> Column:
    """v, and v with one more in each of the segments that are not full: the cells to look in."""
    grown = [F.when(F.shiftrightunsigned(v, 4 * s + 3).bitwiseAND(F.lit(1)) == 0, v.bitwiseOR(F.shiftleft(v, 1).bitwiseAND(F.lit(_signed(15 << 4 * s)))).bitwiseOR(F.lit(_signed(1 << 4 * s)))) for s in segments]
    return F.array_compact(F.array(v, *grown))


def _masked(v: Column, mask: int) -> Column:
    return v.bitwiseAND(F.lit(_signed(mask)))


def placed(points: DataFrame, keys: list[str], parts: list[tuple[int, range, int]]) -> tuple[DataFrame, DataFrame]:
    """(keys, part, cell, __fp, v) of the cells that points lie in, and of those they look in.

    parts are (number, segments, mask).  A cell is a vector of bit counts in the part's
    coordinates.  Of two points within Manhattan distance 1 in these coordinates, one looks
    in the cell in which the other lies.
    """
    own = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), _masked(F.col("v"), mask).alias("cell")) for p, _, mask in parts])).alias("x")
    named = lambda p: lambda cell: F.struct(F.lit(p).alias("part"), cell.alias("cell"))
    look = F.explode(F.flatten(F.array(*[F.transform(_steps(_masked(F.col("v"), mask), segments), named(p)) for p, segments, mask in parts]))).alias("x")
    return tuple(points.select(*keys, "__fp", "v", x).select(*keys, "x.part", "x.cell", "__fp", "v") for x in (own, look))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the positions a[i] and b[i] are joined: each its group's least position."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def _unary(bits: np.ndarray) -> np.ndarray:
    """:func:`embedded` of an array of fingerprints."""
    b = [bits >> np.uint64(k) & np.uint64(_LOW) for k in range(4)]
    any01, all01, any23, all23 = b[0] | b[1], b[0] & b[1], b[2] | b[3], b[2] & b[3]
    return (any01 | any23) | (all01 | all23 | any01 & any23) << np.uint64(1) | (all01 & any23 | any01 & all23) << np.uint64(2) | (all01 & all23) << np.uint64(3)


def _tile(fps: np.ndarray, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, least member) of the components of ``fps``, a slab at a time.

    Pairs pass the Manhattan distance of their counts first, and then the exact distance.
    """
    fps = np.unique(fps)
    bits, label = fps.view(np.uint64), np.arange(len(fps))
    v = _unary(bits)
    for at in range(0, len(fps), step):
        i, j = np.nonzero(np.bitwise_count(v[at : at + step, None] ^ v[None, at:]) <= radius)
        near = np.bitwise_count(bits[i + at] ^ bits[j + at]) <= radius
        label = merged(label, i[near] + at, j[near] + at)
    far = np.flatnonzero(label != np.arange(len(fps)))
    return fps[far], fps[label[far]]


def _found(own: DataFrame, look: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Pairs (a, b) of a cell, one lying and one looking there, under both distances."""
    a = own.select(*keys, F.col("__fp").alias("a"), F.col("v").alias("va"))
    b = look.select(*keys, F.col("__fp").alias("b"), F.col("v").alias("vb"))
    near = (F.col("a") != F.col("b")) & (manhattan(F.col("va"), F.col("vb")) <= radius) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return a.join(b, keys).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(fps: DataFrame, radius: int = 3, crowd: int = 64, tile: int = 1024) -> DataFrame:
    """Links (a, b) whose components are those of "``radius`` (3 at most) or fewer differing bits".

    ``fps`` holds distinct fingerprints (__fp).  Each is mapped to the point of its 16
    segment bit counts.  Points within Manhattan distance 3 are within 1 in one half of the
    coordinates.  The grid's cells are the count vectors of a half: a point lies in one and
    looks in that and in those with one more in one coordinate, so that the range-join is a
    join of cells.  Its pairs pass the Manhattan distance over all coordinates and then the
    exact distance.

    In a cell of over ``crowd`` points the rest of the distance, 3 at most, lies in the
    other half, so the points are placed again, in the same way, by the quarters of that
    half.  A cell of these with over ``crowd`` points is cut into tiles of about ``tile``
    by hash, and every pair of tiles gives stars of its components, never all links.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two halves serve a radius of 0 to 3")
    points = fps.select("__fp", embedded(F.col("__fp")).alias("v"))
    half = [(0, range(8), _HALF), (1, range(8, 16), _HALF << 32)]
    own, look = placed(points, [], half)
    keys = ["part", "cell"]
    sizes = written(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "simhash-cells")
    busy = sizes.where(F.col("n") > crowd)
    found = _found(own.join(busy, keys, "left_anti"), look.join(busy, keys, "left_anti"), keys, radius)

    # crowded cells: the points that look there (those that lie there do too), by quarters of the other half
    both = written(look.join(busy.select(*keys), keys).withColumnsRenamed({"part": "half", "cell": "outer"}), "simhash-crowded")
    inner = []
    for h in (0, 1):
        quarters = [(q, range(4 * q, 4 * q + 4), _QUARTER << 16 * q) for q in ((2, 3) if h == 0 else (0, 1))]
        inner.append(placed(both.where(F.col("half") == h), ["half", "outer"], quarters))
    inner_own, inner_look = (x.unionByName(y) for x, y in zip(*inner, strict=True))
    keys = ["half", "outer", "part", "cell"]
    within = written(inner_own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "simhash-inner")
    busy = within.where(F.col("n") > crowd)
    finer = _found(inner_own.join(busy, keys, "left_anti"), inner_look.join(busy, keys, "left_anti"), keys, radius)

    many = inner_look.select(*keys, "__fp").join(busy, keys)
    n_tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("__fp"), n_tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n_tiles - 1), lambda t: F.struct(F.least(t, mine).alias("i"), F.greatest(t, mine).alias("j")))
    many = many.select(*keys, "__fp", F.explode(pairs).alias("t")).select(*keys, "t.i", "t.j", "__fp")

    def tiles(batch: pd.DataFrame) -> pd.DataFrame:
        left, right = _tile(batch["__fp"].to_numpy(np.int64), radius)
        return pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right)})

    crowded = many.groupBy(*keys, "i", "j").applyInPandas(tiles, "a long, b long")
    return found.unionByName(finer).unionByName(crowded).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) of every row: fingerprints within ``radius`` bits link.

    A shingle is ``width`` words in a row after A-Z become lower case; a text of fewer words
    is one shingle; one without a word, as null, has fingerprint zero, which links like any
    other.  fingerprint is 16 lowercase hex digits.  component_id is the smallest id that
    links reach; a row whose id is null is told its component as any other (null if the
    whole component has null ids).  Repeated rows and equal texts share one fingerprint and
    are compared once.  An empty table gives an empty result; other columns are not read.
    """
    fp = written(fingerprints(docs, id_col, text_col, width, seed), "simhash-fp")
    distinct = written(fp.groupBy("__fp").agg(F.min(id_col).alias("__first")), "simhash-distinct")
    roots = connected_components(links(distinct.select("__fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "__fp"), "__fp", "left").withColumn("root", F.coalesce("root", "__fp"))
    firsts = named.groupBy("root").agg(F.min("__first").alias("component_id"))
    by_fp = named.select("__fp", "root").join(firsts, "root").select("__fp", "component_id")
    out = fp.join(by_fp, "__fp")
    return out.select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; all columns stay.

    Rows with a null id stay only if their whole component has null ids.
    """
    root = free_name(docs.columns, "__component")
    kept = near_dedup(docs, id_col, text_col, **how).where(F.col("component_id").eqNullSafe(F.col(id_col)))
    kept = kept.select(F.col(id_col).alias(root)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(root)), "left_semi")
