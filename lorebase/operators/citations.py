"""Citations: markers and claims, what supports them, sources and their numbers, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import citation_terms

# What ends a sentence, and a marker.
SENTENCE_END = "[.!?。！？\\n]"
MARKER = "\\[(\\d+)\\]"


def claims(reports: DataFrame) -> DataFrame:
    """(report_id, sentence, claim, markers) of (report_id, report): sentences that hold a marker.

    A claim is a sentence without its markers; sentences count from 0.
    """
    parts = reports.select("report_id", F.posexplode(F.split("report", SENTENCE_END)).alias("sentence", "text")).where(F.col("text").rlike(MARKER))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1)), lambda x: x.cast("int"))
    return parts.select("report_id", "sentence", F.regexp_replace("text", MARKER, "").alias("claim"), numbers.alias("markers"))


def supported(claim: Column, source: Column, some: Column | None = None) -> Column:
    """Whether source terms support claim terms: all of up to two, else two and a fifth of them.

    ``some`` tells whether the source has terms, where ``source`` holds only those that claims may share.
    """
    some = F.size(source) > 0 if some is None else some
    both = F.size(F.array_intersect(claim, source))
    enough = F.when(F.size(claim) <= 2, both == F.size(claim)).otherwise((both >= 2) & (both >= F.size(claim) * F.lit(0.2)))
    return (F.size(claim) > 0) & some & enough


def checked_markers(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """(report_id, sentence, index, issue) of every marker; issue is null if the marker is valid.

    sources: (report_id, index, title, url, content, native).  The first rule that holds:
    index_out_of_range (under 1 or above the report's largest index), missing_source,
    empty_source, insufficient_source_content (a URL alone), valid for a provider's own
    citation, unsupported_claim.  A report's claims of one index meet their source once,
    and each then meets only what all of them share with it.
    Sources that are used often may bring their terms (have), and then need no more of title and content than whether they are blank.
    """
    marks = claims(reports).select("report_id", "sentence", citation_terms(F.col("claim")).alias("terms"), F.explode("markers").alias("index"))
    asked = marks.groupBy("report_id", "index").agg(F.collect_list(F.struct("sentence", "terms")).alias("asked"))
    most = sources.groupBy("report_id").agg(F.max("index").alias("most"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    have = F.col("have") if "have" in sources.columns else citation_terms(F.concat_ws(" ", "title", "content"))
    s = sources.select("report_id", "index", (blank("title") & blank("content")).alias("bare"), blank("url").alias("no_url"), F.coalesce("native", F.lit(False)).alias("native"), have.alias("have"), F.lit(True).alias("known"))
    j = asked.join(s, ["report_id", "index"], "left").join(most, "report_id", "left")
    claimed = F.array_distinct(F.flatten(F.transform("asked", lambda a: a["terms"])))
    j = j.select("*", F.array_intersect(claimed, "have").alias("shared"), (F.size("have") > 0).alias("some")).drop("have").select("*", F.explode("asked").alias("a"))
    issue = (
        F.when((F.col("index") < 1) | (F.col("index") > F.coalesce("most", F.lit(0))), "index_out_of_range")
        .when(F.col("known").isNull(), "missing_source")
        .when(F.col("bare") & F.col("no_url"), "empty_source")
        .when(F.col("bare"), "insufficient_source_content")
        .when(F.col("native"), F.lit(None))
        .when(~supported(F.col("a.terms"), F.col("shared"), F.col("some")), "unsupported_claim")
    )
    return j.select("report_id", "a.sentence", "index", issue.alias("issue"))


def citation_summary(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """(report_id, status, total_markers, valid_markers, validity, n_issues, used, unused) of every report.

    Without sources a report is not_applicable if it has no marker and else invalid; with
    sources but without a marker it is invalid; else valid if no marker has an issue.
    """
    marks = checked_markers(reports, sources).groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("issue").isNull()).alias("good"), F.array_sort(F.collect_set(F.when(F.col("issue").isNull(), F.col("index")))).alias("used")
    )
    have = sources.groupBy("report_id").agg(F.array_sort(F.collect_set("index")).alias("have"))
    j = reports.select("report_id").join(marks, "report_id", "left").join(have, "report_id", "left")
    total, good, none = F.coalesce("total", F.lit(0)), F.coalesce("good", F.lit(0)), F.array().cast("array<int>")
    status = F.when(F.col("have").isNull(), F.when(total == 0, "not_applicable").otherwise("invalid")).when((total == 0) | (good < total), "invalid").otherwise("valid")
    validity = F.when(F.col("have").isNull(), F.when(total == 0, 1.0).otherwise(0.0)).when(total == 0, 0.0).otherwise(good / total)
    good = F.when(F.col("have").isNull(), F.lit(0)).otherwise(good)
    text = lambda a: F.array_join(a, ",")
    return j.select(
        "report_id", status.alias("status"), total.alias("total_markers"), good.alias("valid_markers"), validity.alias("validity"), (total - good).alias("n_issues"),
        text(F.coalesce("used", none)).alias("used"), text(F.array_sort(F.array_except(F.coalesce("have", none), F.coalesce("used", none)))).alias("unused"),
    )


def first_sources(hits: DataFrame, by: list[str], order: str) -> DataFrame:
    """Hits with an identity (URL, else chunk, else id), the first of each, numbered from 1."""
    identity = F.coalesce(F.nullif("url", F.lit("")), F.nullif("chunk_id", F.lit("")), F.nullif("id", F.lit("")))
    h = hits.withColumn("identity", identity).where("identity IS NOT NULL")
    h = h.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "identity").orderBy(order))).where("__r = 1")
    return h.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long")).drop("__r")


def running_numbers(sources: DataFrame, by: str) -> DataFrame:
    """(by, call, local, index): the number in a run of each source of its tool calls.

    sources: (by, call, position, local, identity).  An identity is numbered when it first
    comes up, in order of call and position; ``local`` is the number within the call.
    """
    first = sources.groupBy(by, "identity").agg(F.min(F.struct("call", "position")).alias("at"))
    numbered = first.select(by, "identity", F.row_number().over(Window.partitionBy(by).orderBy("at", "identity")).cast("long").alias("index"))
    return sources.join(numbered, [by, "identity"]).select(by, "call", "local", "index")


def citation_map(outputs: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """(by, task, citation_map): local to global numbers of a subtask's sources, joined on identity."""
    j = outputs.join(sources.select(by, "identity", "index"), [by, "identity"])
    pairs = F.array_sort(F.collect_set(F.struct(F.col("local"), F.col("index"))))
    return j.groupBy(by, "task").agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["local"].cast("string"), p["index"].cast("string"))), ",").alias("citation_map"))


def step_outcome(require: Column, strict: Column, has_sources: Column, has_markers: Column, has_text: Column, fallback: Column) -> list[Column]:
    """citation_status, grounding_status, outcome, failure_reason and success of one research step."""
    alone = require & ~has_sources
    model_only = alone & fallback & has_text
    citation = F.when(has_sources & has_markers, "available").when(has_sources, "missing_markers").when(require, "unavailable").otherwise("not_required")
    grounding = F.when(model_only, "model_only").when(require & has_sources & has_markers, "grounded").when(~require, "not_required").otherwise("unavailable")
    outcome = F.when(model_only & strict, "degraded").otherwise("success")
    failure = F.when(model_only, F.when(strict, "sources_unavailable")).when(alone, "sources_unavailable").when(require & ~has_markers, "citation_markers_missing")
    terminal = (alone & ~model_only) | (require & has_sources & ~has_markers)
    success = (has_text | terminal) & ~terminal
    return [citation.alias("citation_status"), grounding.alias("grounding_status"), outcome.alias("outcome"), failure.alias("failure_reason"), success.alias("success")]


def canonical_url(url: Column) -> Column:
    """A citation's URL: no closing punctuation, lower-case scheme and host, no call id as fragment."""
    cut = F.regexp_replace(F.trim(url), "[.,;:!?]+$", "")
    part = lambda n: F.regexp_extract(cut, "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$", n)
    query, fragment = part(4), part(5)
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when((fragment != "") & ~fragment.startswith("ws_call_id="), F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(part(1) == "", cut).otherwise(whole)


def strip_unbacked(report: Column, has_sources: Column) -> Column:
    """Markers, but for those of links, go from a report without sources."""
    return F.when(has_sources, report).otherwise(F.regexp_replace(report, "\\s*\\[[1-9]\\d*\\](?!\\()", ""))
