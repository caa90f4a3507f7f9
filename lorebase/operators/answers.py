"""Functions that the caller passes (models, services), called once for each distinct text, with answers that are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators.kept import Store

#: A function from texts to answers, one each and in their order.
Answers = Callable[[list[str]], list[str | None]]


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def asked(texts: DataFrame, call: Answers, batch: int = 16) -> DataFrame:
    """(digest, answer, error) of each distinct text of ``texts`` (text): null texts aren't asked.

    ``call`` gets up to ``batch`` texts at a time, in a task.  If it raises, or gives another
    number of answers than it got texts, each of these texts has a row with the error and a null answer, and
    the others go on.  A task that is lost is run again, and asks again.
    """
    once = texts.where("text IS NOT NULL").groupBy(digest(F.col("text")).alias("digest")).agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                given = some.column("text").to_pylist()
                try:
                    got, error = list(call(given)), None
                    if len(got) != len(given):
                        raise ValueError(f"{len(got)} answers to {len(given)} texts")
                except Exception as e:  # noqa: BLE001 - what a passed function raises becomes a row
                    got, error = [None] * len(given), f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([some.column("digest"), pa.array(got, pa.string()), pa.array([error] * len(given), pa.string())], ["digest", "answer", "error"])

    return once.mapInArrow(run, "digest string, answer string, error string")


def kept_answers(spark: SparkSession, path: str, texts: DataFrame, call: Answers, batch: int = 16) -> DataFrame:
    """(digest, answer, error) of each distinct text, asked only if the store in ``path`` has no answer yet.

    New answers and failures are committed together; failures are asked again the next time,
    and so is everything if the run fails before its commit.
    """
    store = Store(spark, path)
    now = store.current()
    wanted = texts.where("text IS NOT NULL").select("text", digest(F.col("text")).alias("digest"))
    known = store.read(now, "answers")
    fresh = wanted if known is None else wanted.join(known.where("error IS NULL"), "digest", "left_anti")
    part = store.write("answers", asked(fresh.select("text"), call, batch).withColumn("at", F.lit(now.number + 1)))
    new = store.commit(now.with_parts(answers=part))
    last = store.read(new, "answers").groupBy("digest").agg(F.max_by(F.struct("answer", "error"), "at").alias("r"))
    return last.join(wanted.select("digest").distinct(), "digest", "left_semi").select("digest", "r.*")


def with_answers(rows: DataFrame, answers: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with answer and error of their text; null where the text is null."""
    told = answers.withColumnRenamed("digest", "__digest")
    return rows.withColumn("__asked", digest(F.col(text_col))).join(told, F.col("__asked") == F.col("__digest"), "left").drop("__asked", "__digest")
