"""Indexing of documents over several tables at once: all of a batch becomes visible, or nothing.

Tables of the store (see ``kept``): ``catalog`` has a row for each change of a document, of
which the last counts; ``chunks`` and ``points`` have the rows of every generation of a
document; ``postings``, ``lengths`` and ``gone`` are the keyword index of chunks.  A row
of chunks or points is alive if the catalog's last row of its document names its generation, so a
document is replaced, deleted or restored by rows that are added, and never rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import hash_embedding, point_id
from lorebase.operators import keyword_index
from lorebase.operators.chunking import fixed_chunks
from lorebase.operators.kept import Store, Version
from lorebase.operators.shared import drop_written, written

CATALOG = "doc_id long, content_id string, n_chunks long, status string, error string, generation long, at long"
#: Steps of a batch in order; each may fail, and only the last one makes anything visible.
STEPS = ("chunks", "points", "keywords", "catalog", "commit")


def _none(step: str) -> None:
    """Called before each step."""


def catalog(store: Store, version: Version) -> DataFrame:
    """The last catalog row of every document."""
    rows = store.read(version, "catalog")
    if rows is None:
        return store.spark.createDataFrame([], CATALOG)
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "at").alias("r"))
    return last.select("doc_id", "r.*")


def alive(store: Store, version: Version, name: str) -> DataFrame | None:
    """Rows of ``chunks`` or ``points`` that the catalog names."""
    rows = store.read(version, name)
    if rows is None:
        return None
    named = catalog(store, version).where("status = 'indexed'").select("doc_id", "generation")
    return rows.join(named, ["doc_id", "generation"], "left_semi")


def index_documents(spark: SparkSession, path: str, docs: DataFrame, embed: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = 512, before: Callable[[str], None] = _none) -> Version:
    """Index a batch of documents and return the version that holds it.

    A document whose content is indexed already is passed over.  One without any chunk
    (null, empty or blank) fails: an earlier version of it stays as it is, and a new one gets
    a catalog row of status failed.  Null ids are passed over; of rows of one id the one with the greatest text
    counts.  An error in any step, or the loss of the driver, leaves the version before as it was;
    what was written until then is named by nothing (see ``Store.sweep``).
    """
    store = Store(spark, path)
    now = store.current()
    at = now.number + 1
    embed = embed or hash_embedding
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    if not given.groupBy("doc_id").count().where("count > 1").isEmpty():
        given = given.groupBy("doc_id").agg(F.max("text").alias("text"))
    known = catalog(store, now).select("doc_id", F.col("content_id").alias("__content"), F.col("status").alias("__status"))
    told = written(given.select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 24).alias("content_id")), "batch-contents")
    new_ids = written(told.join(known, "doc_id", "left").where("__status IS NULL OR __status <> 'indexed' OR __content <> content_id").drop("__content"), "batch-fresh")
    # texts are as they were scanned; they meet the catalog only if some of them are passed over
    fresh = given if told.count() == new_ids.count() else given.join(new_ids.select("doc_id"), "doc_id", "left_semi")
    before("chunks")
    cut = fixed_chunks(fresh).withColumn("generation", F.lit(at).cast("long"))
    new = now.with_parts(chunks=store.write("chunks", cut))
    chunks = store.read(Version(at, {"chunks": new.tables["chunks"][-1:]}), "chunks")
    before("points")
    points = chunks.select("doc_id", "generation", "chunk_id", point_id(F.concat_ws(":", F.col("doc_id").cast("string"), "chunk_id")).alias("point_id"), embed(F.col("content")).alias("vector"))
    new = new.with_parts(points=store.write("points", points))
    before("keywords")
    replaced = chunks.select("doc_id").distinct()
    old = alive(store, now, "chunks")
    gone = None if old is None else old.join(replaced, "doc_id", "left_semi").select(_key())
    new = keyword_index.staged(store, new, chunks.select(_key(), F.col("content").alias("text")), gone, "id", "text", block)
    before("catalog")
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    rows = new_ids.join(counts, "doc_id", "left")
    rows = rows.where("n_chunks IS NOT NULL OR __status IS NULL OR __status <> 'indexed'")
    good = F.col("n_chunks").isNotNull()
    rows = rows.select("doc_id", "content_id", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.when(good, "indexed").otherwise("failed").alias("status"), F.when(~good, "empty document").alias("error"), F.lit(at).cast("long").alias("generation"), F.lit(at).cast("long").alias("at"))
    new = new.with_parts(catalog=store.write("catalog", rows))
    drop_written(told, new_ids)
    before("commit")
    return store.commit(Version(at, new.tables, new.facts))


def _key() -> Column:
    """Key of a chunk in the keyword index: numbers, as every posting has one."""
    return F.struct("doc_id", "chunk_no").alias("id")


def delete_documents(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc_id", before: Callable[[str], None] = _none) -> Version:
    """Take documents out of every table; ids that aren't indexed are passed over."""
    store = Store(spark, path)
    now = store.current()
    at = now.number + 1
    wanted = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    there = catalog(store, now).where("status <> 'deleted'").join(wanted, "doc_id", "left_semi")
    before("keywords")
    new, old = now, alive(store, now, "chunks")
    if old is not None:
        new = keyword_index.staged(store, now, None, old.join(wanted, "doc_id", "left_semi").select(_key()), "id")
    before("catalog")
    rows = there.withColumns({"status": F.lit("deleted"), "n_chunks": F.lit(0).cast("long"), "at": F.lit(at).cast("long")})
    new = new.with_parts(catalog=store.write("catalog", rows))
    before("commit")
    return store.commit(Version(at, new.tables, new.facts))


def restore_documents(spark: SparkSession, path: str, ids: DataFrame, number: int, id_col: str = "doc_id", block: int = 512, before: Callable[[str], None] = _none) -> Version:
    """Documents as they were in version ``number``, in a new version; those it doesn't know are deleted.

    Chunks and points of that time are there still, so the catalog names their generation
    again; only the keyword index is given the chunks anew.
    """
    store = Store(spark, path)
    now, then = store.current(), store.current(number)
    at = now.number + 1
    wanted = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    before("keywords")
    gone = alive(store, now, "chunks").join(wanted, "doc_id", "left_semi").select(_key())
    back = alive(store, then, "chunks").join(wanted, "doc_id", "left_semi").select(_key(), F.col("content").alias("text"))
    new = keyword_index.staged(store, now, back, gone, "id", "text", block)
    before("catalog")
    was = catalog(store, then).join(wanted, "doc_id", "left_semi").withColumn("at", F.lit(at).cast("long"))
    lost = catalog(store, now).join(wanted, "doc_id", "left_semi").join(was.select("doc_id"), "doc_id", "left_anti")
    lost = lost.withColumns({"status": F.lit("deleted"), "n_chunks": F.lit(0).cast("long"), "at": F.lit(at).cast("long")})
    new = new.with_parts(catalog=store.write("catalog", was.unionByName(lost)))
    before("commit")
    return store.commit(Version(at, new.tables, new.facts))


def census(store: Store, version: Version) -> DataFrame:
    """(doc_id, status, content_id, n_chunks, n_alive, n_points, n_keyed, digest): the catalog beside what the other tables hold alive."""
    chunks, points = alive(store, version, "chunks"), alive(store, version, "points")
    lengths, dead = store.read(version, "lengths"), keyword_index.dead_rows(store, version)
    keyed = lengths if dead is None else lengths.join(dead.select("seg", "id"), ["seg", "id"], "left_anti")
    of = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_alive"), F.md5(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",")).alias("digest"))
    pts = points.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_points"))
    kys = keyed.groupBy(F.col("id.doc_id")).agg(F.count(F.lit(1)).alias("n_keyed"))
    out = catalog(store, version).join(of, "doc_id", "left").join(pts, "doc_id", "left").join(kys, "doc_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_chunks", "n_alive", "n_points", "n_keyed")]
    return out.select("doc_id", "status", "content_id", *zero, "digest")
