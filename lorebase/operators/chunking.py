"""Cutting documents into chunks that keep their offsets, and putting them together again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import cosine, hash_embedding, short_id
from lorebase.operators.shared import short_batches

# Places to cut, best first.
SEPARATORS = ("\n\n", "\n", "。", ".", "，", ",", " ")


def _cut(text: str, start: int, stop: int) -> int:
    """The end of a chunk that may reach from ``start`` to ``stop``: after the last place of the best separator."""
    if stop >= len(text):
        return len(text)
    for x in SEPARATORS:
        at = text.rfind(x, start + 1, stop)
        if at >= 0:
            return at + len(x)
    return stop


def _bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks as (start, end): each overlaps the one before, where that leaves it further on."""
    ends = [0]
    starts = [0] if text else []
    while starts and len(ends) <= len(starts):
        ends.append(_cut(text, starts[-1], starts[-1] + size))
        if ends[-1] < len(text):
            starts.append(max(ends[-1] - overlap, 0) if ends[-1] - overlap > starts[-1] else ends[-1])
    return [(a, b) for a, b in zip(starts, ends[1:], strict=True) if not text[a:b].isspace()]


def fixed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_no, chunk_start, chunk_end, chunk_id, content), offsets in code points.

    Each start depends on the end before, so a document is cut in one Arrow call; documents
    spread over tasks as they were scanned, without a shuffle.  Arrow batches of texts are bounded.
    """
    short_batches(docs.sparkSession)
    overlap = overlap if overlap < size else size // 4
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for b in batches:
            ids, no, lo, hi, text = [], [], [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, (x, y) in enumerate(_bounds(t or "", size, overlap)):
                    ids.append(doc), no.append(n), lo.append(x), hi.append(y), text.append(t[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(no, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(text, pa.string())], names=[id_col, "chunk_no", "chunk_start", "chunk_end", "content"])

    chunks = docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, chunk_no int, chunk_start int, chunk_end int, content string")
    return chunks.withColumn("chunk_id", short_id(F.col(id_col), F.col("chunk_start"), F.col("chunk_end")))


def reconstruct(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content): chunks without what earlier ones cover; blank lines where offsets are missing."""
    w = Window.partitionBy(id_col).orderBy("chunk_start", "chunk_no")
    covered = F.coalesce(F.max("chunk_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = chunks.withColumn("__new", F.substring(F.col("content"), F.greatest(F.lit(0), covered - F.col("chunk_start")) + 1, F.length("content")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_start", "chunk_no", "__new"))), lambda x: x["__new"]), "")
    loose = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda x: x["content"]), "\n\n")
    return fresh.groupBy(id_col).agg(F.when(F.count_if(F.col("chunk_start").isNull()) > 0, loose).otherwise(whole).alias("content"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, begin, end, sentence): a sentence ends after its mark and the white space behind; blank ones go."""
    parts = F.regexp_extract_all(text_col, F.lit("[^。！？.!?]*[。！？.!?]\\s*|[^。！？.!?]+\\z"), F.lit(0))
    p = docs.select(id_col, F.posexplode(parts).alias("n", "sentence"))
    w = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("begin", F.coalesce(F.sum(F.length("sentence")).over(w), F.lit(0)))
    return p.withColumn("end", F.col("begin") + F.length("sentence")).where(F.regexp_replace("sentence", "\\s+", "") != "")


def semantic_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, embed=None) -> DataFrame:
    """(id, chunk_no, chunk_start, chunk_end, chunk_id): runs of sentences, cut where neighbours differ.

    A chunk ends where the cosine of a sentence and the next is under ``threshold``.
    ``embed`` makes a vector column of a text column; without it vectors are hash embeddings.
    """
    s = sentences(docs, id_col, text_col).withColumn("v", (embed or hash_embedding)(F.trim("sentence")))
    w = Window.partitionBy(id_col).orderBy("n")
    s = s.withColumn("new", (F.round(cosine(F.col("v"), F.lag("v").over(w)), 9) < threshold).cast("int"))
    s = s.withColumn("chunk_no", F.coalesce(F.sum("new").over(w), F.lit(0)).cast("int"))
    c = s.groupBy(id_col, "chunk_no").agg(F.min("begin").alias("chunk_start"), F.max("end").alias("chunk_end"))
    return c.withColumn("chunk_id", short_id(F.col(id_col), F.col("chunk_start"), F.col("chunk_end")))


def element_chunks(elements: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, element, kind, chunk_no, chunk_start, chunk_end, chunk_id) of (doc_id, element, kind, start, content).

    A table of up to ``size`` characters is one chunk, any other element is cut as text; places
    are those of the element's start onward.  Blank elements have none.
    """
    solid = elements.where(F.regexp_replace("content", "\\s+", "") != "")
    whole = (F.col("kind") == "table") & (F.length("content") <= size)
    name = lambda *parts: F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("element"), F.col("element").cast("string"), *[p.cast("string") for p in parts])), 1, 12)
    stop = F.col("start") + F.length("content")
    one = solid.where(whole).select("doc_id", "element", "kind", F.lit(0).alias("chunk_no"), F.col("start").cast("long").alias("chunk_start"), stop.cast("long").alias("chunk_end"), name(F.col("start"), stop).alias("chunk_id"))
    rest = solid.where(~whole).select(F.struct("doc_id", "element", "kind", "start").alias("key"), "content")
    cut = fixed_chunks(rest, "key", "content", size, overlap)
    lo, hi = F.col("start") + F.col("chunk_start"), F.col("start") + F.col("chunk_end")
    cut = cut.select("key.*", "chunk_no", "chunk_start", "chunk_end")
    cut = cut.select("doc_id", "element", "kind", "chunk_no", lo.cast("long").alias("chunk_start"), hi.cast("long").alias("chunk_end"), name(F.col("chunk_no"), lo, hi).alias("chunk_id"))
    return one.unionByName(cut)
