"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, and encoding to pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  :func:`run` writes what a
stage returns as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm import common, exact_dedup, mixing, near_documents, pieces, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores 0.7 or more go; the lexicon is learned from this input.

    Null and empty texts and null ids stay, repeated rows go or stay together, all columns
    are kept whatever their names, and an empty table stays empty.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one of the smallest id stays.

    Null texts count as empty, null ids come last, of rows of one id and text the first in
    the files stays; all columns are kept, and an empty table stays empty.
    """
    return exact_dedup.keep_first(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: linked fingerprints, or 0.8 of all five-word shingles.

    Rows with a null id stay; texts without a word are one group; see ``keep_one``.
    """
    return near_documents.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut stays whole if over half is taken.

    Texts without a word are taken 0 times, a null source is a source of its own, ties go by
    id; all columns are kept, and an empty table stays empty.
    """
    return mixing.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document of the mix; copies of a document get the same pieces.

    Null texts have null pieces, empty ones none; see ``encode_documents``.
    """
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("SimHash near-dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: SQL cannot express the learned lexicon, SimHash or merge-dropout: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
