"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import as_scan, drop_written, forget_kept, short_batches, written
from lorebase.operators.components import connected_components
from lorebase.llm.rolling import Words, mix
from lorebase.llm.simhash import merged

def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def _shingled(words: Words, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, where each paragraph's begin): ``width`` words, or all of fewer."""
    stop = np.append(begins[1:], len(words))
    last = np.repeat(stop, stop - begins)
    at = np.arange(len(words))
    on = (at + width <= last) | (at == np.repeat(begins, stop - begins))
    count = np.maximum(1, stop - begins - width + 1)
    return words.hashes(at[on], np.minimum(at[on] + width, last[on])), np.cumsum(count) - count


def band_hashes(h: np.ndarray, begins: np.ndarray, bands: int, rows: int, factors) -> np.ndarray:
    """For each paragraph one hash a band, of ``rows`` minima over its shingles."""
    out = np.zeros((len(begins), bands), np.uint64)
    for k in range(bands):
        for a, b in zip(factors[0][k * rows : (k + 1) * rows], factors[1][k * rows : (k + 1) * rows], strict=True):
            low = np.minimum.reduceat(mix((h ^ b) * a), begins)
            out[:, k] = mix(out[:, k] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(k))
    return out.view(np.int64)


def _numbered(docs: DataFrame, *columns) -> DataFrame:
    """File and number of each row of a scan, which no change of executors alters."""
    return docs.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *columns)


def _begins(words: Words, radius: int | None) -> np.ndarray:
    """Where paragraphs begin; without a radius, where texts with a word do."""
    return words.cut(radius) if radius else np.unique(words.first[:-1][np.diff(words.first) > 0])


def _whole_if_short(words: Words, begins: np.ndarray, least: int) -> np.ndarray:
    """``begins`` without those inside texts of which no paragraph has ``least`` words: such a text is one paragraph."""
    stop = np.append(begins[1:], len(words))
    of = np.searchsorted(words.first, begins, "right") - 1
    long = np.zeros(len(words.first), bool)
    long[of[stop - begins >= least]] = True
    return begins[long[of] | np.isin(begins, words.first)]


def _joined(words: Words, begins: np.ndarray, least: int) -> np.ndarray:
    """``begins`` without those of paragraphs under ``least`` words, which become part of the one before, at the head of a text of the one behind."""
    begins = begins[(np.append(begins[1:], len(words)) - begins >= least) | np.isin(begins, words.first)]
    head = np.isin(begins, words.first)
    short = head & (np.append(begins[1:], len(words)) - begins < least)
    return begins[~np.append(False, short[:-1] & ~head[1:])] if len(begins) else begins


def split_paragraphs(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, seed: int, radius: int | None, least: int, joined: bool = False) -> DataFrame:
    """(file, row, id, start, words, k1, k2, bands) of every paragraph of ``least`` words or more, or that is a whole text.

    If ``joined`` is set, shorter ones are part of a neighbour, so every word is in a paragraph.  k1 and k2 tell a paragraph's words apart.  Each document also has a line with start -1,
    whose ``words`` counts its paragraphs, so that none is lost.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    factors = _factors(bands * rows, seed)

    def split(batches):
        forget_kept()
        for b in batches:
            words = Words(b.column(3).to_pylist())
            begins = (_joined if joined else _whole_if_short)(words, _begins(words, radius), least)
            stop = np.append(begins[1:], len(words))
            h, at = _shingled(words, begins, width) if len(begins) else (np.zeros(0, np.uint64), begins)
            hashes = band_hashes(h, at, bands, rows, factors) if len(begins) else np.zeros((0, bands), np.int64)
            on = np.flatnonzero((stop - begins >= least) | np.isin(begins, words.first) & np.isin(stop, words.first))
            hashes, begins, stop = hashes[on], begins[on], stop[on]
            of = np.searchsorted(words.first, begins, "right") - 1
            n, m = len(begins), b.num_rows
            rows_of = pa.array(np.concatenate([np.arange(m), of]))
            none = np.zeros(m, np.int64)
            offsets = np.concatenate([none, np.arange(n + 1) * bands])
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(rows_of) for k in range(3)]
                + [
                    pa.array(np.concatenate([none - 1, begins - words.first[of]]), pa.int32()),
                    pa.array(np.concatenate([np.bincount(of, minlength=m), stop - begins]), pa.int32()),
                    pa.array(np.concatenate([none, words.hashes(begins, stop).view(np.int64)])),
                    pa.array(np.concatenate([none, words.hashes(begins, stop, 1).view(np.int64)])),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.ravel())),
                ],
                names=["file", "row", "id", "start", "words", "k1", "k2", "bands"],
            )

    numbered = _numbered(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return numbered.mapInArrow(split, f"file long, row long, id {kind}, start int, words int, k1 long, k2 long, bands array<long>")


def _shingles(docs: DataFrame, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, h): sorted distinct shingle hashes of the paragraphs in ``wanted`` (file, row, start, words, cid)."""
    ask = wanted.groupBy("file", "row").agg(F.collect_list(F.struct("start", "words", "cid")).alias("ask"))

    def read(batches):
        forget_kept()
        for b in batches:
            words = Words(b.column(0).to_pylist())
            cid, h = [], []
            for first, ask in zip(words.first.tolist(), b.column(1).to_pylist(), strict=False):
                for q in ask:
                    a, e = first + q["start"], first + q["start"] + q["words"]
                    at = np.arange(a, max(a + 1, e - width + 1))
                    cid.append(q["cid"])
                    h.append(np.unique(words.hashes(at, np.minimum(at + width, e))).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(h, pa.list_(pa.int64()))], names=["cid", "h"])

    return _numbered(docs, F.col(text_col).alias("text")).join(ask, ["file", "row"]).select("text", "ask").mapInArrow(read, "cid long, h array<long>")


def _tile_stars(cid: np.ndarray, sets: list[np.ndarray], threshold: float, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components of "exact Jaccard >= threshold" among shingle sets; ``size`` tells how many of each they stand for."""
    n = len(cid)
    held = np.fromiter(map(len, sets), np.int64, n)
    size = held if size is None else size
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.arange(n)
    common = np.zeros((n, n), np.float32)
    rows = np.repeat(np.arange(n), held)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    for lo in range(0, len(values), 8192):  # a slab of shingles at a time
        a, b = np.searchsorted(at, [lo, lo + 8192])
        x = np.zeros((n, min(8192, len(values) - lo)), np.float32)
        x[rows[a:b], at[a:b] - lo] = 1
        common += x @ x.T
    i, j = np.nonzero(np.triu(common >= threshold * (size[:, None] + size[None, :] - common) - 1e-4, 1))
    both = common[i, j].astype(np.int64)
    exact = both >= threshold * (size[i] + size[j] - both) - 1e-12
    label = merged(label, i[exact], j[exact])
    far = np.flatnonzero(label != np.arange(n))
    return cid[far], cid[label[far]]


def _tiled(cells: DataFrame, by: list[str], tile: int, *columns: str) -> DataFrame:
    """Rows of crowds (``by``) of ``n`` members, dealt to the pairs (i, j) of tiles that their tile is in."""
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64(columns[0]), tiles).cast("int")
    pairing = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j")))
    return cells.select(*by, *columns, F.explode(pairing).alias("t")).select(*by, *columns, "t.i", "t.j")


def crowd_heads(sets: DataFrame, threshold: float) -> DataFrame:
    """(cid, g, size, rest): each shingle g among the first of a set (cid, h) that another set has among its first too.

    Shingles go by how many sets hold them, rare ones first; a set of ``size`` shingles that has
    ``threshold`` in common with another shares one of its first size - ceil(threshold * size) + 1.
    rest holds g and all that come behind it.
    """
    each = sets.select("cid", F.explode("h").alias("g"))
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(often, "g").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("x"))
    ranked = ranked.select("cid", F.size("x").alias("size"), F.transform("x", lambda y: y["g"]).alias("x"))
    first = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    heads = written(ranked.select("cid", "size", "x", F.posexplode(F.slice("x", F.lit(1), first)).alias("at", "g")).select("cid", "g", "size", F.slice("x", F.col("at") + 1, F.col("size")).alias("rest")), "para-heads")
    met = heads.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    return heads.join(met, "g", "left_semi").select("cid", "g", "size", "rest")


def crowd_links(sets: DataFrame, threshold: float, crowd: int, tile: int) -> DataFrame:
    """(a, b): links with the components of "exact Jaccard >= threshold" among the sets (cid, h), cid 0 or more.

    If g is the first shingle that two sets share, they share what their rests share and no more, so
    sets of one g, size and rest are one class: what links one of two classes links all of both.
    Nodes below 0 are classes.  Sets that hold a common passage and little else are so compared once,
    however many they are.
    """
    heads = written(crowd_heads(sets, threshold), "para-crowds")
    kinds = written(heads.groupBy("g", "size", "rest").agg(F.count(F.lit(1)).alias("copies")).withColumn("kind", -1 - F.monotonically_increasing_id()), "para-kinds")
    enough = lambda both, x, y: both >= threshold * (x + y - both) - 1e-12
    alike = kinds.where((F.col("copies") > 1) & enough(F.size("rest"), F.col("size"), F.col("size"))).select("kind")

    per = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = kinds.join(per, "g").select("g", "n", "kind", "size", "rest")
    few = members.where(F.col("n") <= crowd).drop("n")
    x, y = few.select("g", *[F.col(c).alias(c + "_a") for c in few.columns[1:]]), few.select("g", *[F.col(c).alias(c + "_b") for c in few.columns[1:]])
    most = F.least(F.size("rest_a"), F.size("rest_b"))
    pairs = x.join(y, "g").where((F.col("kind_a") < F.col("kind_b")) & enough(most, F.col("size_a"), F.col("size_b")))
    close = pairs.where(enough(F.size(F.array_intersect("rest_a", "rest_b")), F.col("size_a"), F.col("size_b"))).select(F.col("kind_a").alias("a"), F.col("kind_b").alias("b"))

    def stars(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("kind").sort_values("kind")
        far, near = _tile_stars(group["kind"].to_numpy(), [np.asarray(h, np.int64) for h in group["rest"]], threshold, group["size"].to_numpy().astype(np.int64))
        return pd.DataFrame({"a": near, "b": far})

    dealt = _tiled(members.where(F.col("n") > crowd), ["g"], tile, "kind", "size", "rest")
    between = written(close.unionByName(dealt.groupBy("g", "i", "j").applyInPandas(stars, "a long, b long")), "para-between")
    linked = alike.union(between.select("a")).union(between.select("b")).distinct()
    of = heads.join(kinds.join(linked, "kind", "left_semi").select("g", "size", "rest", "kind"), ["g", "size", "rest"])
    return between.unionByName(of.select(F.col("kind").alias("a"), F.col("cid").alias("b")))


def dedup_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 5, rows: int = 2, seed: int = 17, radius: int | None = 10, least: int = 14, crowd: int = 24, tile: int = 256, joined: bool = False) -> DataFrame:
    """(id, n_paragraphs, n_removed, removed, removed_words, keep_ids) of every row.

    Paragraphs are cut by content: a word begins one if the hash of it and the next is the
    smallest within ``radius`` words (``radius`` None: a whole text is one paragraph).  A
    passage is so cut alike in every text, in longer lines and between other words too.
    If ``joined`` is set, one of under ``least`` words is compared as a part of the one before it (at the
    head of a text, of the one behind), so that every word is compared; else such paragraphs stay.
    A text without a longer one is compared whole, however short, so copies of short texts are found.  Two paragraphs link if
    the exact Jaccard similarity of their sets of ``width``-word shingles is at least
    ``threshold``, or they are equal but for white space; candidates collide in one of
    ``bands`` bands of ``rows`` minima (5 by 2: a pair at 0.8 is missed once in 165, one at
    0.9 once in 4,000).  Of each component the paragraph of the smallest id, then row, then
    place stays; the others go.

    n_paragraphs counts those that are compared; removed holds the numbers (from 0) of the
    first words of those that go, removed_words their lengths in words, keep_ids the ids of
    the rows that hold what stays in their place, in the order of the text.  A null or
    blank text has no paragraphs; null ids come last; repeated rows are copies of each
    other; an empty table gives an empty result; other columns are not read.

    Equal paragraphs become one class before banding.  A band's bucket of up to ``crowd``
    classes gives its pairs, once over all buckets.  Paragraphs of larger ones meet by their
    rarest shingles (:func:`crowd_links`), which loses no link.  Whole texts of larger ones are cut into tiles of
    about ``tile``, whose pairs of tiles each give stars of their components, never all pairs.
    """
    docs = as_scan(docs, "para-docs")
    paras = written(split_paragraphs(docs, id_col, text_col, width, bands, rows, seed, radius, least, joined), "para-lines")
    real = paras.where("start >= 0")
    place = F.struct("file", "row", "start", "words")
    classes = real.groupBy("k1", "k2").agg(F.min(place).alias("at"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "para-classes")

    cells = classes.select("cid", F.posexplode("bands").alias("band", "bucket"))
    crowds = cells.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(cells.join(crowds, ["band", "bucket"]), "para-buckets")
    wanted = members.select("cid").distinct().join(classes, "cid").select("cid", "at.*")
    sets = written(_shingles(docs, text_col, wanted, width), "para-shingles")

    few = members.where(F.col("n") <= crowd).select("band", "bucket", "cid")
    a, b = few.withColumnRenamed("cid", "a"), few.withColumnRenamed("cid", "b")
    pairs = a.join(b, ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    x, y = sets.select(F.col("cid").alias("a"), F.col("h").alias("ha")), sets.select(F.col("cid").alias("b"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    close = pairs.join(x, "a").join(y, "b").where(both >= threshold * (F.size("ha") + F.size("hb") - both) - 1e-12).select("a", "b")

    many = members.where(F.col("n") > crowd)

    def stars(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("cid").sort_values("cid")
        far, near = _tile_stars(group["cid"].to_numpy(), [np.asarray(h, np.int64) for h in group["h"]], threshold)
        return pd.DataFrame({"a": near, "b": far})

    if radius:
        crowded = crowd_links(sets.join(many.select("cid").distinct(), "cid", "left_semi"), threshold, crowd, tile)
    else:  # whole texts have many shingles, and so many first ones
        dealt = _tiled(many, ["band", "bucket"], tile, "cid").join(sets, "cid").select("band", "bucket", "i", "j", "cid", "h")
        crowded = dealt.groupBy("band", "bucket", "i", "j").applyInPandas(stars, "a long, b long")
    links = written(close.unionByName(crowded).distinct(), "para-links")
    drop_written(sets, members)
    roots = written(connected_components(links).select(F.col("node").alias("cid"), "root"), "para-roots")
    # only classes of several copies, or linked to another, can lose a paragraph
    named = classes.select("k1", "k2", "cid", "copies").join(roots, "cid", "left").where("copies > 1 OR root IS NOT NULL")
    lines = real.select("file", "row", "id", "start", "words", "k1", "k2").join(named.select("k1", "k2", F.coalesce("root", "cid").alias("root")), ["k1", "k2"])
    shared = written(lines.select("file", "row", "id", "start", "words", "root"), "para-shared")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("file").alias("file"), F.col("row").alias("row"), F.col("start").alias("start"))
    stays = shared.groupBy("root").agg(F.min(first).alias("keep"))
    gone = shared.join(stays, "root").where(~first.eqNullSafe(F.col("keep")))
    gone = gone.groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("start", "words", F.col("keep.id").alias("id")))).alias("gone"))
    every = paras.where("start < 0").select("file", "row", F.col("id").alias(id_col), F.col("words").cast("long").alias("n_paragraphs")).join(gone, ["file", "row"], "left")
    lost = F.coalesce("gone", F.array().cast(gone.schema["gone"].dataType))
    return every.select(
        id_col,
        "n_paragraphs",
        F.size(lost).cast("long").alias("n_removed"),
        F.transform(lost, lambda p: p["start"]).alias("removed"),
        F.transform(lost, lambda p: p["words"]).alias("removed_words"),
        F.transform(lost, lambda p: p["id"]).alias("keep_ids"),
    )
