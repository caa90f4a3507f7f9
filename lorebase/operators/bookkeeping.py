"""Catalog, facts, costs and lineage: keyed tables that are merged and pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.retrieval import ranked


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, value, change): rows of ``new`` replace rows of ``old`` by key; others are added."""
    o = old.withColumn("__o", F.col(key)).withColumnRenamed("value", "__old")
    merged = o.join(new.withColumnRenamed("value", "__new").withColumn("__n", F.lit(1)), key, "full")
    return merged.select(key, F.coalesce("__new", "__old").alias("value"), F.when(F.col("__n").isNull(), "kept").when(F.col("__o").isNull(), "added").otherwise("replaced").alias("change"))


def upsert_in_order(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(key, value, position): rows of ``new`` replace rows of ``old`` in their places; others come behind all of these, in ``order``.

    old: (key, value, position); new: (key, value, and what ``order`` names), one row a key.
    """
    known = old.select(key, "position", F.col("value").alias("__old"))
    kept = known.join(new.select(key, F.col("value").alias("__new"), F.lit(True).alias("__is")), key, "left").select(key, F.when(F.col("__is"), F.col("__new")).otherwise(F.col("__old")).alias("value"), "position")
    added = ranked(new.join(old.select(key), key, "left_anti").withColumn("__all", F.lit(0)), ["__all"], order, "__nth")
    last = old.agg(F.coalesce(F.max("position"), F.lit(0)).alias("__last"))
    return kept.unionByName(added.crossJoin(F.broadcast(last)).select(key, "value", (F.col("__last") + F.col("__nth")).cast("long").alias("position")))


def replace_group(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups in ``new`` are replaced by its rows."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def signatures(rows: DataFrame, by: str, id_col: str, line: Column, ties: list[str], block: int = 1000, levels: int = 3) -> DataFrame:
    """(by, signature): SHA-256 over the lines of each group in order of ids, taken in levels.

    Lines meet in blocks of ``block`` ids, the blocks' digests in blocks of ``block`` of
    these, and so on for ``levels`` levels; what is left, one digest for each ``block ** levels`` ids,
    meets in the signature.  No row holds more than a block however large a group is.
    """
    of = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), *ties, line.alias("line"))))
    blocks = rows.groupBy(by, F.floor(F.col(id_col) / block).alias("block")).agg(F.sha2(F.array_join(F.transform(of, lambda x: x["line"]), ";"), 256).alias("h"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ";")
    for _ in range(levels - 1):
        blocks = blocks.groupBy(by, F.floor(F.col("block") / block).alias("above")).agg(F.sha2(every, 256).alias("h")).withColumnRenamed("above", "block")
    return blocks.groupBy(by).agg(F.sha2(every, 256).alias("signature"))


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """(fact_id, sources, confidence, at, n) of (content, source, confidence, at): facts by content."""
    f = facts.withColumn("fact_id", F.substring(F.md5("content"), 1, 12))
    return f.groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("confidence").alias("confidence"), F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))


def prune(rows: DataFrame, by: list[str], time: str, tie: str, oldest, newest: int) -> DataFrame:
    """Rows not older than ``oldest``, the ``newest`` latest of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(time), F.desc(tie))
    return rows.where(F.col(time) >= oldest).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= newest).drop("__r")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost and status to (model, provider, prompt, cached, completion).

    A price of provider:model goes before one of the model; rates are per million tokens;
    local providers cost nothing; without a price the cost is null.
    """
    p = F.broadcast(prices)
    exact = p.select(F.col("name").alias("__k1"), F.struct("input", "cached_input", "output").alias("__p1"))
    loose = p.select(F.col("name").alias("__k2"), F.struct("input", "cached_input", "output").alias("__p2"))
    u = usage.join(exact, F.concat_ws(":", "provider", "model") == F.col("__k1"), "left").join(loose, F.col("model") == F.col("__k2"), "left")
    rate = F.coalesce("__p1", "__p2")
    fresh = F.greatest(F.col("prompt") - F.col("cached"), F.lit(0))
    cost = (fresh * rate["input"] + F.col("cached") * F.coalesce(rate["cached_input"], rate["input"]) + F.col("completion") * rate["output"]) / F.lit(1e6)
    local = F.col("provider") == "local"
    status = F.when(local, "not_applicable").when(rate.isNull(), "pricing_unconfigured").otherwise("estimated")
    return u.withColumn("cost", F.round(F.when(local, 0.0).otherwise(cost), 10)).withColumn("status", status).drop("__k1", "__k2", "__p1", "__p2")


def cost_status(calls: DataFrame, by: str) -> DataFrame:
    """(by, cost, status): sums, and partial / estimated / pricing_unconfigured / not_applicable."""
    est, miss = F.count_if(F.col("status") == "estimated"), F.count_if(F.col("status") == "pricing_unconfigured")
    free = F.count_if(F.col("status") == "not_applicable")
    status = F.when((est > 0) & (miss > 0), "partial").when(est > 0, "estimated").when(miss > 0, "pricing_unconfigured").when(free > 0, "not_applicable").otherwise("usage_unavailable")
    cost = F.when(est > 0, F.round(F.sum(F.when(F.col("status") == "estimated", F.col("cost"))), 6))
    return calls.groupBy(by).agg(cost.alias("cost"), status.alias("status"))


def verify_citations(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """(report_id, n_markers, n_valid, used, unused, invalid): markers [n] against source indices.

    Lists are joined by commas in rising order.
    """
    numbers = F.transform(F.regexp_extract_all("report", F.lit("\\[([1-9][0-9]*)\\]"), F.lit(1)), lambda x: x.cast("int"))
    marks = reports.select("report_id", numbers.alias("m"))
    have = sources.groupBy("report_id").agg(F.collect_set("index").alias("s"))
    j = marks.join(have, "report_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<int>")))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return j.select(
        "report_id", F.size("m").cast("long").alias("n_markers"), F.size(F.filter("m", lambda x: F.array_contains(F.col("s"), x))).cast("long").alias("n_valid"),
        text(F.array_intersect("m", "s")).alias("used"), text(F.array_except("s", "m")).alias("unused"), text(F.array_except("m", "s")).alias("invalid"),
    )


def number_sources(sources: DataFrame, by: list[str], identity: str, order: list[str]) -> DataFrame:
    """(by, identity, index): distinct sources numbered from 1 by first occurrence."""
    first = sources.groupBy(*by, identity).agg(F.min(F.struct(*order)).alias("__at"))
    return first.select(*by, identity, F.row_number().over(Window.partitionBy(*by).orderBy("__at", identity)).cast("long").alias("index"))


def appended(old: DataFrame, new: DataFrame, by: str, order: str) -> DataFrame:
    """``old`` and the rows of ``new``, whose sequence goes on from the group's last one."""
    last = old.groupBy(by).agg(F.max("sequence").alias("__last"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return old.unionByName(new.join(last, by, "left").withColumn("sequence", (F.coalesce("__last", F.lit(0)) + nth).cast("long")).select(*old.columns))


def retained(rows: DataFrame, by: str, time: str, oldest: Column) -> DataFrame:
    """All rows of the groups whose newest row is not older than ``oldest``."""
    live = rows.groupBy(by).agg(F.max(time).alias("__at")).where(F.col("__at") >= oldest).select(by)
    return rows.join(live, by, "left_semi")
