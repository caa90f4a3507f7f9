"""The shared folder of a session, and tables that are written there and read again.

A written table outlives the loss of any executor and cuts the lineage; nothing is kept in an
executor's own folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one is set up only where a local session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lorebase-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.lorebase.scratch", named)
    return spark.conf.get("spark.lorebase.scratch", None) or named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again with its own schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table, about, that may go whole through the driver to every executor.
FEW = 100_000


def by_shuffle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join: with more than ``FEW`` rows, or a number that isn't known, both sides are shuffled.

    Spark goes by bytes as they are compressed, so it would still send tables of many narrow rows through the driver.
    """
    return df if rows is not None and rows <= FEW else df.hint("merge")


def short_batches(spark: SparkSession, rows: int = 256, size: str = "1m") -> None:
    """Bound the rows and bytes of an Arrow batch, so that batches of very long texts stay small.

    Spark takes these settings from the session when a query runs, which for a lazy result is
    after the operator has returned; so they stay set, and the last operator called holds.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, path)
