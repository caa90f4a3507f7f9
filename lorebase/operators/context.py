"""Context of a request: candidates, policy, stored artifacts and memories, earlier turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import lexical_relevance, lexical_terms


def candidates(*parts: DataFrame) -> DataFrame:
    """Candidates of several kinds under each other; columns that a kind lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def relevance(query: Column, content: Column) -> Column:
    """Lexical relevance of a content, of which 20,000 characters count."""
    return lexical_relevance(lexical_terms(query), lexical_terms(F.substring(content, 1, 20000)))


def exclusion_reason(mode: Column, excluded: Column, selected: Column, expires: Column, now: Column, kind: Column, grounding: Column, score: Column, kept: Column, least: float = 0.12) -> Column:
    """Why a candidate stays out, the first rule that holds; null if it may stay.

    user_excluded, not_selected (manual mode), expired, model_only (artifacts), low_relevance
    (auto mode; messages, artifacts and memories that nothing else keeps: ``kept`` says so of
    pinned and referenced ones and of the latest turn).
    """
    low = (mode == "auto") & kind.isin("message", "artifact", "memory") & ~kept & ~selected & (score < least)
    return (
        F.when(excluded, "user_excluded")
        .when((mode == "manual") & ~selected, "not_selected")
        .when(expires <= now, "expired")
        .when((kind == "artifact") & (grounding == "model_only"), "model_only")
        .when(low, "low_relevance")
    )


def newest_then_relevant(rows: DataFrame, by: list[str], time: list, now: Column, score: Column, newest: int, top: int) -> DataFrame:
    """The ``newest`` rows of each group that have not expired, then the ``top`` most relevant of these.

    Expiry is tested after the cut to the newest, so expired rows use up places.
    """
    w = Window.partitionBy(*by)
    rows = rows.withColumn("__new", F.row_number().over(w.orderBy(*time))).where(F.col("__new") <= newest)
    rows = rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).withColumn("relevance", score)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("relevance"), "__new")).cast("long")).where(F.col("rank") <= top).drop("__new")


def referenced_turn(queries: DataFrame, turns: DataFrame, by: str) -> DataFrame:
    """(by, turn_no, relevance): the turn most relevant to a group's query, the latest of equals.

    Without any relevance it is the latest turn.  queries: (by, query), turns: (by, turn_no, content).
    """
    scored = turns.join(queries, by).select(by, "turn_no", relevance(F.col("query"), F.col("content")).alias("relevance"))
    return scored.groupBy(by).agg(F.max(F.struct("relevance", "turn_no")).alias("x")).select(by, F.col("x.turn_no").alias("turn_no"), F.col("x.relevance").alias("relevance"))


def ids_problem(selected: Column, excluded: Column) -> Column:
    """What is wrong with a request's context ids: blank, charset, overlap; null if nothing."""
    trimmed = lambda ids: F.array_distinct(F.transform(ids, lambda i: F.trim(i)))
    s, x = trimmed(selected), trimmed(excluded)
    both = F.concat(s, x)
    return F.when(F.exists(both, lambda i: i == ""), "blank").when(~F.forall(both, lambda i: i.rlike("^[A-Za-z0-9:_.-]+$")), "charset").when(F.arrays_overlap(s, x), "overlap")


def fingerprint(items: DataFrame, by: str, query: str, order: str, policy: str = "context-policy-v1", embedding: str = "lexical-v1") -> DataFrame:
    """(by, fingerprint): SHA-256 of a bundle's canonical JSON, keys sorted, without spaces.

    items: (by, query, order, id, title, content, reason, freshness), one bundle a group; a
    bundle is bounded by its token budget.
    """
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    item = F.concat(F.lit('{"content":"'), F.sha2("content", 256), F.lit('","freshness":'), text(F.col("freshness")), F.lit(',"id":'), text(F.col("id")), F.lit(',"selection_reason":'), text(F.col("reason")), F.lit(',"title":'), text(F.col("title")), F.lit("}"))
    g = items.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("j")))), lambda x: x["j"]), ",").alias("list"), F.first(query).alias("q"))
    doc = F.concat(F.lit(f'{{"embedding":"{embedding}","items":['), F.col("list"), F.lit(f'],"policy":"{policy}","query":'), text(F.trim("q")), F.lit("}"))
    return g.select(by, F.sha2(doc, 256).alias("fingerprint"))
