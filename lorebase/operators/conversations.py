"""Messages: sequences, turns, recency, context candidates, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import estimate_tokens


def recency(messages: DataFrame) -> DataFrame:
    """Adds recency: 0 for the newest message of a conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("recency", (F.row_number().over(w) - 1).cast("int"))


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, asked, answered): a user message opens a turn, its last answer closes it.

    Messages before the first user message are turn 0; only user and assistant messages count.
    """
    said = messages.where(F.col("role").isin("user", "assistant"))
    opened = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    t = said.withColumn("turn_no", opened)
    return t.groupBy("conv_id", "turn_no").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("asked"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("answered"))


def context_score(relevance: Column, recency_rank: Column, pinned: Column, latest: Column, quality: Column) -> Column:
    """Relevance plus bonuses: pinned 0.65, latest turn 0.35 or recency up to 0.2, quality up to 0.2."""
    fresh = F.when(latest, F.lit(0.35)).otherwise(F.greatest(F.lit(0.0), F.lit(0.2) - recency_rank * F.lit(0.03)))
    good = F.when(quality.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(0.2), quality / F.lit(50.0)))).otherwise(0.0)
    return F.greatest(F.lit(0.0), relevance + F.when(pinned, F.lit(0.65)).otherwise(0.0) + fresh + good)


def allocate_budget(candidates: DataFrame, group: str, order: list[str], budget: int, chars_per_token: int = 4, max_chars: int = 4000) -> DataFrame:
    """(group, order..., tokens, verdict): candidates in order, as long as they fit.

    A candidate that doesn't fit is passed over and later ones may still fit; a text that
    was selected before is a duplicate; a blank one is empty.  Needs each group's rows in
    order, so a group (one request's candidates) is one pandas call.
    """
    bounded = F.substring(F.trim(F.coalesce(F.col("content"), F.lit(""))), 1, max_chars)
    rows = candidates.select(group, *order, F.md5(bounded).alias("__text"), F.when(bounded == "", 0).otherwise(estimate_tokens(bounded, chars_per_token)).alias("tokens"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(group, *order).schema)

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        used, seen, verdict = 0, set(), []
        for text, n in zip(g["__text"], g["tokens"], strict=True):
            if not n:
                verdict.append("empty")
            elif text in seen:
                verdict.append("duplicate")
            elif used + n > budget:
                verdict.append("budget_exceeded")
            else:
                used += n
                seen.add(text)
                verdict.append("selected")
        return g.drop(columns="__text").assign(verdict=verdict)

    return rows.groupBy(group).applyInPandas(fill, f"{fields}, tokens long, verdict string")


def visible(messages: DataFrame, newest: int) -> DataFrame:
    """The ``newest`` user and assistant messages of each conversation, oldest first."""
    said = messages.where(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return said.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= newest).drop("__r")


def visible_or_selected(messages: DataFrame, deleted: Column, selected: DataFrame, newest: int, key: list[str]) -> DataFrame:
    """Messages that aren't deleted: the newest of each conversation, and those that ``selected`` names by ``key``, with which it was (``why``)."""
    there = messages.where(F.col("role").isin("user", "assistant") & ~F.coalesce(deleted, F.lit(False)))
    picked = there.join(selected.select(*key).distinct().withColumn("__picked", F.lit(True)), key, "left")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    told = picked.withColumn("why", F.when(F.row_number().over(w) <= newest, "newest").when(F.col("__picked"), "selected"))
    return told.where("why IS NOT NULL").drop("__picked")


def refresh_window(messages: DataFrame, threshold: int, keep: int) -> DataFrame:
    """(conv_id, from_turn, to_turn, n): what a summary of all but the last ``keep`` messages covers.

    Only conversations with over ``threshold`` messages are summarised.
    """
    w = Window.partitionBy("conv_id")
    r = messages.withColumn("n_all", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("turn"))))
    old = r.where((F.col("n_all") > threshold) & (F.col("r") > keep))
    return old.groupBy("conv_id").agg(F.min("turn").alias("from_turn"), F.max("turn").alias("to_turn"), F.count(F.lit(1)).alias("n"))


def active(conversations: DataFrame, deleted: Column) -> DataFrame:
    """Conversations that are not marked deleted."""
    return conversations.where(~deleted)


def active_summary(summaries: DataFrame) -> DataFrame:
    """The active summary of each conversation that reaches furthest, the latest version of equals."""
    rest = [c for c in summaries.columns if c not in ("conv_id", "status")]
    best = F.max_by(F.struct(*rest), F.struct("to_turn", "version"))
    return summaries.where("status = 'active'").groupBy("conv_id").agg(best.alias("x")).select("conv_id", "x.*")
