"""What models answer, read and bounded: JSON in text, graph items, routes; and trees of summaries."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorebase.functions.text import hash_embedding
from lorebase.operators.context import referenced_turn
from lorebase.operators.shared import written

# How follow-up questions look.
FOLLOW_UP = [
    "(刚才|之前|上一个|上一轮|前面|继续|接着|再展开|进一步)",
    "(这个|那个|它|其|该方案|第二个|第一个|上述|前述)",
    "^(?:有)?(?:什么|哪些)?(?:区别|风险|优缺点)(?:呢)?[？?]?$",
    "^(?:相比|比较|为什么|怎么做|怎么办)(?:呢)?[？?]?$",
    "^(那|那么|还有|以及|另外|然后)",
]


@F.pandas_udf(StringType())
def first_json_list(raw: pd.Series) -> pd.Series:
    """The JSON list that a text is, or else its first balanced bracket span, if that is a list; null without one."""

    def span(text: str) -> str | None:
        depth, start = 0, text.find("[")
        for i in range(start, len(text) if start >= 0 else -1):
            depth += (text[i] == "[") - (text[i] == "]")
            if depth == 0:
                return text[start : i + 1]
        return None

    def found(text):
        for t in ((text or "").strip(), span((text or "").strip())):
            try:
                if t is not None and isinstance(json.loads(t), list):
                    return t
            except (ValueError, RecursionError):  # nested too deep to be an answer
                pass
        return None

    return raw.map(found)


@F.pandas_udf(StringType())
def first_json_object(raw: pd.Series) -> pd.Series:
    """The first JSON object in a text, as text; null without one."""
    decoder = json.JSONDecoder()

    def found(text):
        at = (text or "").find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(text, at)[0])
            except (ValueError, RecursionError):
                at = text.find("{", at + 1)
        return None

    return raw.map(found)


def graph_items(answers: DataFrame, entities: int = 20, relations: int = 80) -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, id, name, type, description) and relations (doc_id, source, target, relation_type, weight).

    answers: (doc_id, raw), what a model said of a document.  The first ``entities`` and
    ``relations`` of a document count; fields are cut at 200, 500 and 2,000 characters; weights
    that are not finite are 1 and others held in 0 to 1.
    """
    item = "array<struct<type:string,id:string,name:string,entity_type:string,description:string,source:string,target:string,relation_type:string,weight:string>>"
    x = answers.select("doc_id", F.posexplode(F.from_json(first_json_list("raw"), item)).alias("at", "x")).select("doc_id", "at", "x.*")
    nth = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("at"))
    x = x.where(F.col("type").isin("entity", "relation")).withColumn("nth", nth)
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    w = F.col("weight").try_cast("double")
    weight = F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)))
    e = x.where((F.col("type") == "entity") & (F.col("nth") <= entities)).select("doc_id", cut("id", 200).alias("id"), cut("name", 500).alias("name"), cut("entity_type", 200).alias("type"), cut("description", 2000).alias("description"))
    r = x.where((F.col("type") == "relation") & (F.col("nth") <= relations)).select("doc_id", cut("source", 200).alias("source"), cut("target", 200).alias("target"), cut("relation_type", 200).alias("relation_type"), weight.alias("weight"))
    return e, r


def route(raw: Column, least: float = 0.72) -> Column:
    """(route, answer, confidence, reason) of a router's answer.

    A direct answer needs a text and a confidence of ``least``; anything else, what cannot
    be read too, is research.
    """
    p = F.from_json(first_json_object(raw), "route string, answer string, confidence string, reason string")
    c = p["confidence"].try_cast("double")
    confidence = F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    text = F.trim(F.coalesce(p["answer"], F.lit("")))
    asks = p["route"] == "direct_answer"
    direct = F.coalesce(asks & (text != "") & (confidence >= least), F.lit(False))
    why = F.substring(F.trim(F.coalesce(p["reason"], F.lit(""))), 1, 500)
    reason = F.when(F.coalesce(asks, F.lit(False)) & ~direct & (why == ""), F.when(text == "", "empty_answer").otherwise("below_threshold")).otherwise(why)
    return F.struct(F.when(direct, "direct_answer").otherwise("research").alias("route"), F.when(direct, text).otherwise("").alias("answer"), confidence.alias("confidence"), reason.alias("reason"))


def resolved(queries: DataFrame, turns: DataFrame, by: str) -> DataFrame:
    """(by, follows, turn_no, confidence, standalone): questions with the turn they follow up.

    queries: (by, query), turns: (by, turn_no, content, n).  A question that follows nothing
    stands alone with confidence 1; one without a turn to follow has 0.35, with a whole turn
    0.82, with half a turn 0.68, and is put behind that turn's content.
    """
    q = queries.withColumn("query", F.trim("query")).withColumn("follows", F.exists(F.array(*[F.lit(p) for p in FOLLOW_UP]), lambda p: F.regexp_like(F.col("query"), p)))
    best = referenced_turn(q.where("follows").select(by, "query"), turns, by).select(by, "turn_no")
    j = q.join(best, by, "left").join(turns.select(by, "turn_no", "content", "n"), [by, "turn_no"], "left")
    confidence = F.when(~F.col("follows"), 1.0).when(F.col("turn_no").isNull(), 0.35).when(F.col("n") == 2, 0.82).otherwise(0.68)
    alone = F.when(F.col("turn_no").isNull(), F.col("query")).otherwise(F.concat("content", F.lit("\n\n"), "query"))
    return j.select(by, "follows", "turn_no", confidence.alias("confidence"), alone.alias("standalone"))


def unmet(parsed: DataFrame) -> DataFrame:
    """(id, failures): what a parsed document lacks of what was expected, in order.

    parsed: (id, ocr_pages, native_pages, tables, kinds, reasons) and the expectations
    (least_ocr, least_native, least_tables, want_kinds, want_reasons).
    """
    few = lambda have, want, name: F.when(F.coalesce(have, F.lit(0)) < F.coalesce(want, F.lit(0)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    lacks = lambda want, have, head: F.transform(F.array_except(want, have), lambda x: F.concat(F.lit(head), x))
    failures = F.concat(few(F.col("ocr_pages"), F.col("least_ocr"), "ocr_pages"), few(F.col("native_pages"), F.col("least_native"), "native_pages"), few(F.col("tables"), F.col("least_tables"), "tables"), lacks(F.col("want_kinds"), F.col("kinds"), "kind:"), lacks(F.col("want_reasons"), F.col("reasons"), "reason:"))
    return parsed.select("id", failures.alias("failures"))


def greedy_clusters(vectors: list, threshold: float) -> list[int]:
    """Each position's cluster, named by its first member: in order, a member takes all later ones that are close.

    Up to three positions are one cluster; a position without a vector is one of its own.
    """
    n = len(vectors)
    if n <= 3:
        return [0] * n
    out = np.full(n, -1)
    some = np.array([i for i, v in enumerate(vectors) if v is not None], int)
    x = np.array([vectors[i] for i in some], float)
    norm = np.linalg.norm(x, axis=1) if len(some) else np.zeros(0)
    free = np.ones(len(some), bool)
    for k, i in enumerate(some):
        if free[k]:  # a leader: one product with all that are left
            left = np.flatnonzero(free[k:]) + k
            near = left[x[left] @ x[k] / (norm[left] * norm[k] + 1e-8) > threshold]
            out[some[near]] = i
            free[near] = False
            out[i], free[k] = i, False
    return np.where(out < 0, np.arange(n), out).tolist()


def _by_document(batches):
    """Arrow batches of whole documents (doc_id first) from sorted ones: each with the row that each document begins at, and the end."""
    rest = None
    for b in chain(batches, [None]):
        if b is not None:
            rest = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            ids = rest.column(0).to_pylist()
        elif rest is None:
            return
        begins = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        if b is None:
            begins.append(len(ids))
        if len(begins) > 1:  # the last document may go on in the next batch
            yield rest.slice(0, begins[-1]).combine_chunks().to_batches()[0], begins
            rest, ids = rest.slice(begins[-1]), ids[begins[-1] :]


def _vectors(column: pa.Array) -> list:
    """Rows of a list column as views of one array of doubles, null for null."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [flat[a:e] if some else None for a, e, some in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]


def _in_order(nodes: DataFrame, v: Column | None) -> DataFrame:
    """Each document's nodes come to one task in order of n, v first vectored there if it is told how."""
    sorted_nodes = nodes.repartition("doc_id").sortWithinPartitions("doc_id", "n")
    return sorted_nodes if v is None else sorted_nodes.withColumn("v", v)


def clustered(nodes: DataFrame, threshold: float, v: Column | None = None) -> DataFrame:
    """Adds cluster to (doc_id, n, v, ...): greedy clusters of each document's nodes in order of n.

    Nodes stream to their document's task in order, and one document is held at a time.
    ``v`` makes the vector column there.
    """
    x = _in_order(nodes, v).select("doc_id", "n", "v", *[c for c in nodes.columns if c not in ("doc_id", "n", "v")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)

    def cut(batches):
        for b, begins in _by_document(batches):
            n, vectors = b.column(1).to_numpy(), _vectors(b.column(2))
            named = [n[i:j][greedy_clusters(vectors[i:j], threshold)] for i, j in zip(begins, begins[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(named), pa.int64())], names=[*b.schema.names, "cluster"])

    return x.mapInArrow(cut, f"{fields}, cluster long")


def gathered(nodes: DataFrame, threshold: float, v: Column) -> DataFrame:
    """(doc_id, n, v, texts): the texts of each cluster of (doc_id, n, text) in order, named by its first member; v of those that are alone."""
    x = _in_order(nodes, v).select("doc_id", "n", "v", "text")

    def cut(batches):
        for b, begins in _by_document(batches):
            vectors = _vectors(b.column(2))
            first = np.concatenate([np.array(greedy_clusters(vectors[i:j], threshold), np.int64) + i for i, j in zip(begins, begins[1:], strict=False)])
            order = np.argsort(first, kind="stable")
            heads, at = np.unique(first[order], return_index=True)
            texts = pa.ListArray.from_arrays(pa.array(np.append(at, len(first)), pa.int32()), b.column(3).take(pa.array(order)))
            alone = pa.array(heads, mask=np.diff(np.append(at, len(first))) > 1)
            heads = pa.array(heads)
            yield pa.RecordBatch.from_arrays([b.column(0).take(heads), b.column(1).take(heads), b.column(2).take(alone), texts], names=["doc_id", "n", "v", "texts"])

    kind = nodes.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(cut, f"doc_id {kind}, n long, v {x.schema['v'].dataType.simpleString()}, texts array<string>")


def summary_tree(chunks: DataFrame, levels: int = 3, threshold: float = 0.7, summarise: Callable[[Column], Column] | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, level, n, n_children, text): levels of summaries over a document's chunks (doc_id, n, text).

    Nodes of a level are clustered; a cluster of several makes a node above, named by its
    first member, and single ones are carried up.  It ends after ``levels`` levels or when a
    level makes no node.  ``summarise`` makes a text of an array of texts, ``embed`` a vector
    of a text, once for each node; without them a summary is the beginnings of its children, and vectors are hashes.
    """
    summarise = summarise or (lambda texts: F.array_join(F.transform(texts, lambda t: F.substring(t, 1, 80)), " "))
    embed = embed or hash_embedding
    now = chunks.select("doc_id", F.col("n").cast("long").alias("n"), "text")
    made = None
    for level in range(1, levels + 1):
        vector = embed(F.col("text")) if made is None else F.coalesce("v", embed(F.when(F.col("v").isNull(), F.col("text"))))
        up = gathered(now, threshold, vector).withColumn("n_children", F.size("texts").cast("long"))
        up = written(up.select("doc_id", "n", "v", "n_children", F.when(F.col("n_children") > 1, summarise(F.col("texts"))).otherwise(F.col("texts")[0]).alias("text")), "summaries")
        new = up.where("n_children > 1").select("doc_id", F.lit(level).alias("level"), "n", "n_children", "text")
        made = new if made is None else made.unionByName(new)
        if new.isEmpty():
            break
        now = up.select("doc_id", "n", "v", "text")
    return made
