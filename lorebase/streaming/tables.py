"""Streaming forms: incremental indexing of a drop folder, and trace roll-up by session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import short_id
from lorebase.operators.chunking import fixed_chunks
from lorebase.operators.shared import scratch_path


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or one file."""
    seen = spark.read.parquet(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    files = seen.inputFiles()
    reader = spark.readStream.schema(seen.schema)
    if len(files) == 1 and files[0].rsplit("/", 1)[-1] == name:
        return reader.option("pathGlobFilter", name).parquet(path.rstrip("/").rsplit("/", 1)[0])
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str, name: str, home: str | None = None) -> DataFrame:
    """Run a streaming query over all that is there, and return what its sink holds.

    With the same ``home`` the next call goes on where this one ended.  The sink keeps the
    result of each batch under its number, so a batch that is run again replaces itself; with
    several batches in update mode, callers take the latest row of a key.
    """
    spark = stream.sparkSession
    home = home or scratch_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{home}/out").drop("batch")


def indexed_chunks(spark: SparkSession, path: str, home: str | None = None) -> DataFrame:
    """(doc_id, source, chunk_no, chunk_start, chunk_end, chunk_id) of the documents of a folder.

    A document is cut once, by id, however often its file comes: the state holds the ids.
    With the same ``home`` only what came since is cut, and earlier chunks stay.
    """
    docs = stream_of(spark, path).select("doc_id", "source", "text").dropDuplicates(["doc_id"])
    cut = fixed_chunks(docs.select(F.struct("doc_id", "source").alias("key"), "text"), "key", "text").select("key.*", "chunk_no", "chunk_start", "chunk_end")
    rows = drained(cut, "append", "index-jobs", home).drop("__batch")
    return rows.withColumn("chunk_id", short_id(F.col("doc_id"), F.col("chunk_start"), F.col("chunk_end")))


def cached_results(spark: SparkSession, path: str, ttl: str = "1 day", home: str | None = None) -> DataFrame:
    """(user_id, event_type, cached): the newest result of each key that has not expired.

    The state holds one row a key; a result expires ``ttl`` after it came, measured at the
    newest result of all, as a stream that is drained has no clock of its own.
    """
    e = stream_of(spark, path)
    newest = e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("cached"), F.max("ts").alias("at"))
    rows = drained(newest, "update", "result-cache", home)
    last = rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("cached", "at"), "__batch").alias("x")).select("user_id", "event_type", "x.*")
    now = last.agg(F.max("at").alias("now"))
    return last.crossJoin(F.broadcast(now)).where(F.expr(f"at >= now - INTERVAL {ttl}")).select("user_id", "event_type", "cached")


def session_rollup(spark: SparkSession, path: str, gap: str = "6 hours") -> DataFrame:
    """(user_id, start, n): sessions of events that are less than ``gap`` apart."""
    events = stream_of(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    rows = drained(s.select("user_id", F.col("w.start").alias("start"), "last", "n"), "complete", "sessions")
    newest = rows.agg(F.max("__batch").alias("b"))
    return rows.join(F.broadcast(newest), F.col("__batch") == F.col("b")).drop("__batch", "b")
