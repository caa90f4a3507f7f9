"""A kept keyword index: postings in blocks, updates as segments and tombstones, BM25 that passes over blocks.

Tables of the store (see ``kept``): ``postings`` has a row for each term and block of
documents, with how many of them hold the term, the most often it comes up in one, the
length of the shortest, and the documents; ``lengths`` has a row a document; ``gone`` names documents whose
rows in earlier segments are dead.  Documents are dealt to blocks of like length, as a short
document is what lets a term weigh much; rows are sorted by term, so a search reads few files' row groups.

A search bounds what each block can give a query from the heads alone, scores the most
promising blocks, and then only those whose bound reaches the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions.text import words
from lorebase.operators.kept import Store, Version
from lorebase.operators.retrieval import term_counts, top_k
from lorebase.operators.shared import drop_written, short_batches, written

#: A search of at most so many terms names them to the scan; with more they are only joined.
_NAMED_TERMS = 5000


@dataclass(frozen=True)
class Found:
    """``rows``: (query_id, id, score, rank).  ``blocks``: (query_id, seg, block, docs_bound, read) of every block with a term of the query."""

    rows: DataFrame
    blocks: DataFrame


def _length_class(dl: Column) -> Column:
    """Lengths in half octaves."""
    return F.floor(2 * F.log2(F.greatest(dl, F.lit(1)).cast("double"))).cast("int")


def _block_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``postings`` of (block, id, words), which come in order of block; one block is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        of = b.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                if held and of[lo] != now:
                    yield from _lists(held, now)
                    held = []
                now = of[lo]
                held += term_counts([pa.RecordBatch.from_arrays(b.slice(lo, hi - lo).columns[1:], ["id", "words"])])
    if held:
        yield from _lists(held, now)


def _lists(held: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(term, block, n, top_tf, low_dl, docs) of a block's (id, dl, term, tf), some documents at a time."""
    t = pa.Table.from_batches(held).combine_chunks()
    term = t.column("term").combine_chunks().dictionary_encode() if len(t) else None
    if term is None:
        return
    code = term.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
    ends = np.append(first[1:], len(order))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + 100_000, "right")))
        at = order[first[lo] : ends[hi - 1]]
        begins = first[lo:hi] - first[lo]
        some = t.take(pa.array(at))
        tf, dl = some.column("tf").to_numpy().astype(np.int32), some.column("dl").to_numpy()
        docs = pa.StructArray.from_arrays([some.column("id").combine_chunks(), pa.array(tf), pa.array(dl)], ["id", "tf", "dl"])
        offsets = pa.array(np.append(begins, len(at)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [term.dictionary.take(pa.array(code[at[begins]])), pa.array(np.full(hi - lo, block, np.int32)), pa.array((ends - first)[lo:hi].astype(np.int32)), pa.array(np.maximum.reduceat(tf, begins)), pa.array(np.minimum.reduceat(dl, begins)), pa.ListArray.from_arrays(offsets, docs)],
            ["term", "block", "n", "top_tf", "low_dl", "docs"],
        )
        lo = hi


def _sorted_files(blocks: DataFrame) -> DataFrame:
    return blocks.sortWithinPartitions("term", "block")


def _segment(store: Store, version: Version, docs: DataFrame, block: int) -> Version:
    """``version`` with one more segment of ``docs`` (id, text).

    What is shuffled is each text, once, to its block; a block's postings are made where its texts are.
    """
    seg = int(version.facts.get("segments", 0)) + 1
    short_batches(docs.sparkSession)
    lengths = written(docs.select("id", F.size(words(F.coalesce("text", F.lit("")))).cast("int").alias("dl")), "index-lengths")
    sizes = lengths.groupBy(_length_class(F.col("dl")).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()
    first, at = [], 0
    for r in sizes:  # a few dozen classes of length
        n = -(-r.n // block)
        first += [F.lit(r.c), F.struct(F.lit(at).alias("at"), F.lit(n).alias("n"))]
        at += n
    place = lambda dl: F.element_at(F.create_map(*first), _length_class(dl)) if first else F.lit(None).cast("struct<at:int,n:int>")
    dealt = lambda dl: (place(dl)["at"] + F.pmod(F.xxhash64("id"), place(dl)["n"])).cast("int")
    length = F.size(words(F.coalesce("text", F.lit("")))).cast("int")
    rows = docs.withColumn("block", dealt(length)).repartition("block").sortWithinPartitions("block")
    listed = rows.select("block", "id", words(F.coalesce("text", F.lit(""))).alias("words"))
    kind = dict(docs.dtypes)["id"]
    blocks = listed.mapInArrow(_block_lists, f"term string, block int, n int, top_tf int, low_dl int, docs array<struct<id:{kind},tf:int,dl:int>>")
    new = version.with_parts(postings=store.write("postings", _sorted_files(blocks).withColumn("seg", F.lit(seg))), lengths=store.write("lengths", lengths.select("id", "dl", dealt(F.col("dl")).alias("block"), F.lit(seg).alias("seg"))))
    drop_written(lengths)
    new.facts["segments"] = seg
    return new


def _alive_docs(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """``rows`` of postings without the documents of ``dead`` (seg, block, id): the dead of a block meet its rows as one list."""
    if dead is None:
        return rows
    lost = dead.groupBy("seg", "block").agg(F.collect_set("id").alias("__lost"))
    j = rows.join(lost, ["seg", "block"], "left")
    left = F.filter("docs", lambda d: ~F.array_contains("__lost", d["id"]))
    return j.withColumn("docs", F.when(F.col("__lost").isNull(), F.col("docs")).otherwise(left)).drop("__lost").where(F.size("docs") > 0)


def dead_rows(store: Store, version: Version) -> DataFrame | None:
    """(seg, block, id) of the rows that later segments replaced or deletes took away."""
    gone, lengths = store.read(version, "gone"), store.read(version, "lengths")
    if gone is None or lengths is None:
        return None
    last = gone.groupBy("id").agg(F.max("seg").alias("since"))
    return lengths.join(last, "id").where(F.col("seg") < F.col("since")).select("seg", "block", "id")


def _counted(store: Store, version: Version) -> Version:
    """The number and the lengths of the documents that are alive, as facts; only the narrow table is read."""
    lengths, dead = store.read(version, "lengths"), dead_rows(store, version)
    alive = lengths if dead is None else lengths.join(dead.select("seg", "id"), ["seg", "id"], "left_anti")
    n, total = alive.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first() if lengths is not None else (0, 0)
    version.facts.update(docs=n, words=total)
    return version


def staged(store: Store, version: Version, docs: DataFrame | None = None, gone: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> Version:
    """``version`` with ``docs`` put in and the ids of ``gone`` taken out, written but not committed.

    Documents of an id that is there replace it.  Null ids are passed over; of rows of one id
    the one with the greatest text counts; null texts are documents without terms.
    """
    new, seg = version, int(version.facts.get("segments", 0))
    if docs is not None:
        docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
        if docs.groupBy("id").count().where("count > 1").limit(1).count():
            docs = docs.groupBy("id").agg(F.max("text").alias("text"))
        new = _segment(store, new, docs, block)
    taken = []
    if docs is not None and version.tables.get("lengths"):
        taken.append(docs.select("id", F.lit(seg + 1).alias("seg")))
    if gone is not None:
        taken.append(gone.select(F.col(id_col).alias("id"), F.lit(seg + 1).alias("seg")))
    if taken and version.tables.get("lengths"):
        known = store.read(version, "lengths").select("id")
        rows = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
        new = new.with_parts(gone=store.write("gone", rows.join(known, "id", "left_semi").distinct()))
    new = Version(version.number + 1, new.tables, new.facts)
    new.facts["segments"] = seg + 1
    return _counted(store, new)


def build(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 512, most: int | None = None) -> Version:
    """An index of ``docs`` as the newest version in ``path``; more than ``most`` documents are an error."""
    store = Store(spark, path)
    now = store.current()
    new = staged(store, Version(now.number), docs, None, id_col, text_col, block)
    if most is not None and new.facts["docs"] > most:
        raise ValueError(f"{new.facts['docs']} documents, {most} allowed")
    return store.commit(new)


def upsert(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> Version:
    store = Store(spark, path)
    return store.commit(staged(store, store.current(), docs, None, id_col, text_col, block))


def delete(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc_id") -> Version:
    store = Store(spark, path)
    return store.commit(staged(store, store.current(), None, ids, id_col))


def compact(spark: SparkSession, path: str, block: int = 512) -> Version:
    """One segment of what is alive, made of the postings and not of the documents.

    Whole blocks of like length are put together until they hold ``block`` documents; lists of a block that stays alone are not shuffled.
    """
    store = Store(spark, path)
    now = store.current()
    found, lengths = store.read(now, "postings"), store.read(now, "lengths")
    if found is None:
        return now
    dead = dead_rows(store, now)
    if dead is not None:
        dead = written(dead, "index-dead")
        lengths = lengths.join(dead.select("seg", "id"), ["seg", "id"], "left_anti")
    held = lengths.groupBy("seg", "block").agg(F.count(F.lit(1)).alias("n"), _length_class(F.min("dl")).alias("c"))
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("seg", "block"))
    held = held.withColumn("at", F.floor((upto - 1) / block))
    groups = held.groupBy("c", "at").agg(F.count(F.lit(1)).alias("parts"))
    groups = groups.withColumn("new", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("c", "at")) - 1).cast("int"))  # a row for each block
    moved = written(held.join(groups, ["c", "at"]).select("seg", "block", "new", "parts"), "index-moved")
    rows = _alive_docs(found.select("term", "seg", "block", "docs"), dead).join(moved, ["seg", "block"])
    apart = rows.where("parts = 1").select("term", F.col("new").alias("block"), "docs")
    together = rows.where("parts > 1").groupBy("term", F.col("new").alias("block")).agg(F.flatten(F.collect_list("docs")).alias("docs"))
    most = lambda f, x: F.aggregate(F.transform("docs", lambda d: d[x]), F.lit(None).cast("int"), lambda a, b: f(a, b))
    blocks = apart.unionByName(together).select("term", "block", F.size("docs").alias("n"), most(F.greatest, "tf").alias("top_tf"), most(F.least, "dl").alias("low_dl"), "docs")
    seg = 1
    new = Version(now.number, {}, {}).with_parts(postings=store.write("postings", _sorted_files(blocks).withColumn("seg", F.lit(seg))), lengths=store.write("lengths", lengths.join(moved, ["seg", "block"]).select("id", "dl", F.col("new").alias("block"), F.lit(seg).alias("seg"))))
    new.facts["segments"] = seg
    return store.commit(_counted(store, Version(now.number + 1, new.tables, new.facts)))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, first_blocks: int = 4, version: int | None = None, without: DataFrame | None = None) -> Found:
    """The best ``k`` documents with a positive score for each of ``queries`` (query_id, text), as ``bm25`` over the documents alive.

    Documents are not read.  ``without`` (id) leaves documents out of the result, not out of
    the statistics.  Bounds hold for documents that are dead or left out too, so blocks with
    such documents are at most read in vain.  Scores are ranked by six places, so a bound
    within that of the k-th score is read as well.  An index without documents finds nothing.
    """
    store = Store(spark, path)
    now = store.current(version)
    q = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    found = store.read(now, "postings")
    kind = dict(store.read(now, "lengths").dtypes)["id"] if found is not None else "long"
    if found is None or not now.facts["words"]:
        nothing = q.where("false").select("query_id", F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return Found(nothing, q.where("false").select("query_id", F.lit(0).alias("seg"), F.lit(0).alias("block"), F.lit(0.0).alias("upper"), F.lit(True).alias("read")))
    n, average = now.facts["docs"], now.facts["words"] / now.facts["docs"]
    terms = [r.term for r in q.select("term").distinct().limit(_NAMED_TERMS + 1).collect()]
    mine = found.where(F.col("term").isin(terms)) if 0 < len(terms) <= _NAMED_TERMS else found
    heads = written(mine.select("term", "seg", "block", "n", "top_tf", "low_dl").join(q.select("term").distinct(), "term"), "index-heads")
    counts = heads.groupBy("term").agg(F.sum("n").alias("df"))
    dead = dead_rows(store, now)
    if dead is not None:
        dead = written(dead, "index-dead")
        bodies = mine.join(q.select("term").distinct(), "term").join(dead.select("seg", "block").distinct(), ["seg", "block"], "left_semi")
        lost = bodies.select("term", "seg", F.explode("docs.id").alias("id")).join(dead, ["seg", "id"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("lost"))
        counts = counts.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
    part = lambda tf, dl: tf / (tf + k1 * (1 - b + b * dl / F.lit(average)))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = written(q.join(counts, "term").select("query_id", "term", idf.alias("idf")), "index-weights")
    bounds = heads.join(weights, "term").groupBy("query_id", "seg", "block").agg(F.sum(F.col("idf") * part(F.col("top_tf"), F.col("low_dl"))).alias("upper"))
    bounds = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "seg", "block")))
    bounds = written(bounds, "index-bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("query_id", "seg", "block").join(weights, "query_id")
        hits = mine.select("term", "seg", "block", "docs").join(wanted, ["term", "seg", "block"]).select("query_id", "seg", "idf", F.explode("docs").alias("d"))
        hits = hits.select("query_id", "seg", F.col("d.id").alias("id"), (F.col("idf") * part(F.col("d.tf"), F.col("d.dl"))).alias("x"))
        if dead is not None:
            hits = hits.join(dead.select("seg", "id"), ["seg", "id"], "left_anti")
        if without is not None:
            hits = hits.join(without.select("id").distinct(), "id", "left_anti")
        return hits.groupBy("query_id", "id").agg(F.sum("x").alias("score")).where("score > 0")

    order = [F.round("score", 6).desc(), F.col("id")]
    first = written(top_k(scored(bounds.where(F.col("nth") <= first_blocks)), ["query_id"], order, k), "index-first")
    reached = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    marked = bounds.join(reached, "query_id", "left")
    more = (F.col("nth") > first_blocks) & (F.col("reached").isNull() | (F.col("upper") >= F.col("reached") - 2e-6))
    rest = top_k(scored(marked.where(more)), ["query_id"], order, k)
    rows = top_k(first.drop("rank").unionByName(rest.drop("rank")), ["query_id"], order, k)
    blocks = marked.select("query_id", "seg", "block", "upper", ((F.col("nth") <= first_blocks) | more).alias("read"))
    return Found(rows, blocks)


def statistics(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(term, df, cf) over the documents alive, from postings alone."""
    store = Store(spark, path)
    now = store.current(version)
    rows, dead = store.read(now, "postings"), dead_rows(store, now)
    lists = _alive_docs(rows, dead)
    held = lists.select("term", F.size("docs").cast("long").alias("n"), F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["tf"]).alias("all"))
    return held.groupBy("term").agg(F.sum("n").alias("df"), F.sum("all").alias("cf"))
