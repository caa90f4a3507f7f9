"""Exact dedup as a keyed stream: DataFrame and SQL functions only.

The stream's state lives in RocksDB on the executors' disks and is saved in the stream's
checkpoint, in the shared folder.  Its key is the SHA-256 digest of the normalised text; its
value holds the smallest identifier, the content locator of that row and a row count.  No
watermark is set, so no key ever expires.
"""

from __future__ import annotations

import contextlib
import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.common import SPACE, as_scan, drop_written, free_name, scratch_path, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


#: Texts meet in a shuffle only if a Bloom filter of the groups with hits lets them through.
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10GB",
}


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _digest(text_col: str) -> Column:
    return F.sha2(normalised(F.col(text_col)), 256)


def _locator() -> Column:
    """File and row number of a row of a scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def digest_log(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __at, __digest): what the stream reads of each row; __at is the content locator."""
    return docs.select(F.col(id_col).alias("__id"), _locator().alias("__at"), _digest(text_col).alias("__digest"))


def stream_state(spark: SparkSession, log: str, schema, checkpoint: str, max_files: int | None = None) -> DataFrame:
    """Run the keyed stream over every file now in ``log`` and return its state.

    Running it again with the same ``checkpoint`` takes in only files that came since; keys
    of earlier runs are still known.  Result: __digest, __first (identifier and locator of
    the smallest row), __n.  A task opens its part of the state, saves it and lets it go, so
    memory follows the tasks that run at once and not the number of parts.
    """
    with _set(spark, _STATE):
        reader = spark.readStream.schema(schema)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        state = reader.option("recursiveFileLookup", "true").parquet(log).groupBy("__digest").agg(F.min(_rank("__id", "__at")).alias("__first"), F.count(F.lit(1)).alias("__n"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    kept = spark.read.format("statestore").load(checkpoint)
    value = kept.schema["value"].dataType.fieldNames()
    return kept.select(F.col("key").getField("__digest").alias("__digest"), F.col("value").getField(value[0]).alias("__first"), F.col("value").getField(value[1]).alias("__n"))


def _is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write of ``path`` has ended: its files come in place at the end."""
    try:
        return bool(spark.read.parquet(path).inputFiles())
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def _rank(id_col: str, at: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(at).alias("at"))


def decisions(docs: DataFrame, id_col: str, text_col: str, checkpoint: str | None = None, earlier: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """(__id, __at, __digest, __keep, __n, __kept) of every row of ``docs``, a scan of files.

    A hit is checked on its full bytes: rows of a group meet the row that the locator in the
    state names, and texts that differ from it (a digest collision) are grouped again by the
    text itself.  Rows of a group are dealt by locator into buckets, of which there is one
    for each ``share`` rows of the table; the text that stays is sent to each bucket that
    has a row of its group, so no group meets in one task, however large it is.

    Texts are read twice: once for their digests, once if their digest is a group's.
    ``checkpoint`` names the folder of the stream and of the log it reads; with the same
    one, keys of earlier tables count.  A table's log is named by the table's files, so a run that
    is repeated after a crash, or by mistake, counts its rows once.  ``earlier`` is a scan of these tables' files, in which first texts are looked up.
    """
    if checkpoint and earlier is None:
        raise ValueError("full bytes of earlier rows cannot be checked without their table")
    spark = docs.sparkSession
    log = written(digest_log(docs, id_col, text_col), "dedup-log")
    home = checkpoint or scratch_path(spark, "dedup-state")
    if checkpoint:  # the stream goes on where it read before
        path = f"{home}/log"
        own = f"{path}/{hashlib.sha256(chr(10).join(sorted(docs.inputFiles())).encode()).hexdigest()}"
        if not _is_written(spark, own):
            log.write.mode("overwrite").parquet(own)
    else:
        path = log.inputFiles()[0].rsplit("/", 1)[0]
    state = written(stream_state(spark, path, log.schema, f"{home}/stream"), "dedup-groups")
    hits = state.where("__n > 1").select("__digest", "__first", "__n")
    buckets = 1 + log.count() // share
    bucket = F.pmod(F.xxhash64("__at"), F.lit(buckets)).alias("__bucket")
    with _set(spark, _BLOOM):
        read = lambda d: d.select(_locator().alias("__at"), _digest(text_col).alias("__digest"), normalised(F.col(text_col)).alias("__text"))
        text = read(docs)
        copies = written(text.join(hits.select("__digest"), "__digest").select("__at", "__digest", bucket, "__text"), "dedup-copies")
    firsts = hits.select("__digest", F.col("__first.at").alias("__at"))
    known = copies.select("__at", "__digest", "__text")
    if earlier is not None:
        known = known.unionByName(read(earlier))
    stays = known.join(firsts, ["__digest", "__at"]).select("__digest", F.col("__text").alias("__kept_text"))
    dealt = copies.select("__digest", "__bucket").distinct()
    told = dealt.join(stays, "__digest")
    odd = written(copies.join(told, ["__digest", "__bucket"]).where("__text <> __kept_text").select("__at", "__digest", "__text"), "dedup-collisions")
    rows = log.join(hits, "__digest", "left")
    first, n = F.col("__first"), F.coalesce("__n", F.lit(1))
    if odd.limit(1).count():  # texts of one digest that differ
        mine = odd.join(log, ["__digest", "__at"]).withColumn("__rank", _rank("__id", "__at"))
        others = mine.groupBy("__digest", "__text").agg(F.min("__rank").alias("__mine"), F.count(F.lit(1)).alias("__m"))
        lost = odd.groupBy("__digest").agg(F.count(F.lit(1)).alias("__lost"))
        of = odd.join(others, ["__digest", "__text"]).select("__at", "__mine", "__m")
        rows = rows.join(lost, "__digest", "left").join(of, "__at", "left")
        first = F.coalesce("__mine", first)
        n = F.coalesce("__m", F.col("__n") - F.coalesce("__lost", F.lit(0)), F.lit(1))
    alone = n == 1
    rows = rows.select("__id", "__at", "__digest", F.when(alone, F.col("__id")).otherwise(first["id"]).alias("__keep"), n.cast("long").alias("__n"), (alone | (F.col("__at") == first["at"])).alias("__kept"))
    out = written(rows, "dedup-rows")
    drop_written(log, state, copies, odd)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Mark the row of each group of equal texts that stays; drops no row.

    Adds to each row of ``docs``: keep_id, group_size, kept, text_sha256.  Equal means equal
    after white-space runs become one space, null counting as empty.  The row with the
    smallest id stays; rows with a null id come last; among rows of one id the one first in
    the files stays.  Very long texts are never collected: only digests are shuffled with
    the stream, and only texts of groups with more than one row are compared in full.
    Columns of the input that have one of the four names are replaced, all others kept,
    whatever their names; an empty table gives an empty result.  With ``checkpoint`` and
    ``earlier`` the stream goes on: equal rows of earlier tables come first if their id does.
    """
    docs = as_scan(docs.drop("keep_id", "group_size", "kept", "text_sha256"), "dedup-docs")
    at = free_name(docs.columns, "__where")
    marks = decisions(docs.select(*dict.fromkeys([id_col, text_col])), id_col, text_col, checkpoint, earlier)
    marks = marks.select(F.col("__at").alias(at), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"), F.col("__kept").alias("kept"), F.col("__digest").alias("text_sha256"))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], _locator().alias(at)).join(marks, at).drop(at)


def exact_dedup_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`exact_dedup`, but with the id as the only column kept: rows are not read again."""
    docs = as_scan(docs.select(*dict.fromkeys([id_col, text_col])), "dedup-docs")
    marks = decisions(docs, id_col, text_col)
    return marks.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"), F.col("__kept").alias("kept"), F.col("__digest").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns and nothing else; see :func:`exact_dedup`."""
    docs = as_scan(docs, "dedup-docs")
    at = free_name(docs.columns, "__where")
    gone = decisions(docs.select(*dict.fromkeys([id_col, text_col])), id_col, text_col).where("NOT __kept").select(F.col("__at").alias(at))
    return docs.select("*", _locator().alias(at)).join(gone, at, "left_anti").drop(at)
