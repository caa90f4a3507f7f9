"""Near-duplicate documents for the pipeline: SimHash groups, completed by exact similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm import paragraphs, simhash
from lorebase.llm.common import as_scan, free_name
from lorebase.operators.components import connected_components


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of near copies does; all columns kept.

    Two documents link if their SimHash fingerprints over ``width``-word shingles differ in
    ``radius`` bits or fewer, or if the exact Jaccard similarity of their shingles is at
    least ``similarity``.  Fingerprints alone miss most pairs at 0.8, which lie some ten bits
    apart, so candidates for the exact check come from MinHash bands of whole documents.
    The smallest id of a group stays.  Ids are unique after exact dedup; rows that repeat an
    id go or stay together.  Rows with a null id stay, as nothing can name them; an empty
    table gives an empty result.  Texts without a word link with each other.
    """
    docs = as_scan(docs, "near-docs")
    named = docs.where(F.col(id_col).isNotNull())
    by_bits = simhash.near_dedup(named, id_col, text_col, width, radius).select(F.col(id_col).alias("a"), F.col("component_id").alias("b"))
    by_words = paragraphs.dedup_paragraphs(named, id_col, text_col, width, similarity, bands=12, rows=3, radius=None, least=1).where("n_removed > 0")
    links = by_bits.unionByName(by_words.select(F.col(id_col).alias("a"), F.get("keep_ids", F.lit(0)).alias("b")))
    gone = free_name(docs.columns, "__gone")
    others = connected_components(links.where("a <> b")).where("node <> root").select(F.col("node").alias(gone))
    return docs.join(others, F.col(id_col) == F.col(gone), "left_anti")
