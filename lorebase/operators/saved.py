"""Tables that are saved whole and loaded under limits: facts, episodes, graphs; listings of traces; prompts under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.operators.bookkeeping import prune
from lorebase.operators.kept import Store, Version

# What a prompt writes.
CUT = "\n\n[该子任务内容因上下文预算已截断]"
ALL_CUT = "\n\n[子任务上下文已达到综合预算上限]"


def save(spark: SparkSession, path: str, **tables: DataFrame) -> Version:
    """Replace the tables of a store by these, all of them or, if anything fails, none."""
    store = Store(spark, path)
    parts = {name: [store.write(name, df)] for name, df in tables.items()}
    return store.commit(store.current().with_parts(**parts))


def load(spark: SparkSession, path: str, *names: str) -> list[DataFrame | None]:
    """Tables as they were saved last; None for one that never was."""
    store = Store(spark, path)
    now = store.current()
    return [store.read(now, name) for name in names]


def load_facts(spark: SparkSession, path: str, oldest: Column, newest: int, chars: int = 2000, task_chars: int = 2000, sources: int = 100, source_chars: int = 1000) -> DataFrame | None:
    """Facts under their limits: texts and sources cut, those older than ``oldest`` gone, the ``newest`` of each category kept."""
    (facts,) = load(spark, path, "facts")
    if facts is None:
        return None
    cut = F.transform(F.slice(F.coalesce("sources", F.array().cast("array<string>")), 1, sources), lambda s: F.substring(s, 1, source_chars))
    facts = facts.withColumns({"content": F.substring("content", 1, chars), "task": F.substring(F.coalesce("task", F.lit("")), 1, task_chars), "sources": cut, "confidence": F.coalesce("confidence", F.lit(0.5)), "category": F.coalesce("category", F.lit("general"))})
    return prune(facts, ["category"], "timestamp", "fact_id", oldest, newest)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(entities, adjacency, members): neighbours in both directions made anew; community members that are no entity dropped, whole communities kept."""
    entities, relations, members = load(spark, path, "entities", "relations", "members")
    if entities is None or relations is None or members is None:
        return None
    ends = relations.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(relations.select(F.col("target").alias("node"), F.col("source").alias("neighbour")))
    known = entities.select("entity_id", F.lit(True).alias("__is"))
    told = members.join(known, "entity_id", "left").select("community", F.when(F.col("__is"), F.col("entity_id")).alias("entity_id"))
    return entities, ends.where("node <> neighbour").distinct(), told.groupBy("community").agg(F.count("entity_id").alias("n_members"), F.min("entity_id").alias("first"))


def listed(summaries: DataFrame, at: str, tie: str, valid: Column, scan: int, limit: int) -> DataFrame:
    """The newest ``limit`` valid summaries among the ``scan`` newest of all, and truncated: whether there are more than were scanned."""
    newest = summaries.orderBy(F.col(at).desc(), F.col(tie)).limit(scan)
    shown = newest.where(valid).orderBy(F.col(at).desc(), F.col(tie)).limit(limit)
    more = summaries.agg((F.count(F.lit(1)) > scan).alias("truncated"))
    return shown.crossJoin(F.broadcast(more))


def bounded(text: Column, most: Column, mark: str) -> Column:
    """A text without white space around it; a longer one than ``most`` is cut, and ends with ``mark``."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, F.lit(1), most.cast("int")), "\\s+$", ""), F.lit(mark)))


def findings(subtasks: DataFrame, by: str, order: str, description: str, output: str, mapping: str, budget: int) -> DataFrame:
    """(by, n, findings): a section a subtask, in order, whose outputs share ``budget`` characters evenly, and the whole is cut at it.

    Each output has its share less 300 for what stands around it, 100 at least; ``mapping`` is an
    array of (local, global) citation numbers, which are told in up to 1,000 characters.
    """
    w = Window.partitionBy(by)
    rows = subtasks.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(w))
    share = F.greatest(F.lit(100), F.floor(F.lit(max(200, budget)) / F.col("__n")) - 300)
    pairs = F.array_join(F.transform(mapping, lambda m: F.format_string("局部 [%s] -> 全局 [%s]", m["local"].cast("string"), m["global"].cast("string"))), "，")
    told = F.when(F.size(mapping) > 0, F.substring(F.concat(F.lit("\n\n该子任务的引用编号映射："), pairs, F.lit("。最终答案必须改用全局编号。")), 1, 1000)).otherwise("")
    label = F.substring(F.regexp_replace(F.coalesce(description, F.lit("")), "^\\s+|\\s+$", ""), 1, 500)
    line = F.concat(F.lit("### 子任务 "), F.col("__i").cast("string"), F.lit(": "), label, F.lit("\n\n"), bounded(F.col(output), share, CUT), told, F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", line.alias("l")))), lambda x: x["l"]), "\n")
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), text.alias("t"))
    cut = F.concat(F.regexp_replace(F.substring("t", 1, budget), "\\s+$", ""), F.lit(ALL_CUT))
    return out.select(by, "n", F.when(F.length("t") > budget, cut).otherwise(F.col("t")).alias("findings"))


def captioned(assets: DataFrame, captions: DataFrame, at: Column) -> DataFrame:
    """Assets whose metadata (a map) take in captions (asset_id, caption, model, prompt_version); ids without an asset are passed over."""
    new = F.create_map(F.lit("caption"), F.col("caption"), F.lit("caption_model"), F.col("model"), F.lit("caption_prompt_version"), F.col("prompt_version"), F.lit("captioned_at"), at.cast("string"))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("caption", "caption_model", "caption_prompt_version", "captioned_at"))
    j = assets.join(captions.withColumn("__new", new).select("asset_id", "__new"), "asset_id", "left")
    return j.withColumn("metadata", F.when(F.col("__new").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, "__new"))).drop("__new")


def qa_markdown(pairs: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, n, markdown): questions and answers of each group as one file, numbered anew from 1 in order."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    block = F.concat(F.lit("### Q"), F.col("__i").cast("string"), F.lit("\n"), F.coalesce("question", F.lit("")), F.lit("\n**A:** "), F.coalesce("answer", F.lit("")), F.lit("\n\n"))
    rows = pairs.withColumn("__i", nth).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", block.alias("b")))), lambda x: x["b"]), "").alias("b"))
    head = F.concat(F.lit("# "), F.col(by).cast("string"), F.lit(" QA 测试集\n> 共 "), F.col("n").cast("string"), F.lit(" 条问答对\n"))
    return rows.select(by, "n", F.concat(head, "b").alias("markdown"))


def settings_signature(settings: dict[str, Column]) -> Column:
    """SHA-256 of settings as JSON: keys in order, no spaces, nulls told; what changes a setting changes the signature."""
    return F.sha2(F.to_json(F.struct(*[settings[k].alias(k) for k in sorted(settings)]), {"ignoreNullFields": "false"}), 256)
