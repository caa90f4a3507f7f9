"""Results of runs: which may be reused or remembered, what they leave, and texts under budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.memory import budget_fold, freshness


def reuse_problem(output: Column, sources: Column, needs_sources: Column, outcome: Column, failed_subtasks: Column, quality: Column, citation: Column, planner: Column, same_fingerprint: Column) -> Column:
    """Why a cached result isn't reused, the first rule that holds; null if it is.

    empty, refresh (nested links or call ids), unsourced, degraded, fallback_plan, fingerprint.
    """
    stale = (F.contains(output, F.lit("](")) & F.contains(output, F.lit("]([")))  | F.contains(output, F.lit("ws_call_id=")) | F.exists(sources, lambda u: F.contains(u, F.lit("ws_call_id=")))
    unsourced = needs_sources & ((F.size(sources) == 0) | ~output.rlike("\\[[1-9]\\d*\\]"))
    degraded = (F.lower(F.trim(outcome)) == "degraded") | (failed_subtasks > 0) | (quality == "evaluation_failed") | (citation == "invalid")
    return F.when(F.trim(output) == "", "empty").when(stale, "refresh").when(unsourced, "unsourced").when(F.coalesce(degraded, F.lit(False)), "degraded").when(planner == "fallback", "fallback_plan").when(~same_fingerprint, "fingerprint")


def remembered(success: Column, outcome: Column, grounding: Column, quality: Column, evaluated: Column, least: float = 7.0) -> tuple[Column, Column, Column]:
    """Whether a run is kept as an episode, whether as a fact, and the fact's confidence."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    episode = success & (clean(outcome) != "degraded") & (clean(grounding) != "model_only")
    fact = episode & evaluated & F.coalesce(quality >= least, F.lit(False))
    return episode, fact, F.when(quality > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality / 10.0))).otherwise(0.5)


def reusable_indexes(catalog: DataFrame, vectors: DataFrame, postings: DataFrame) -> DataFrame:
    """Indexed documents whose chunk counts in the catalog, the vectors and the postings agree."""
    count = lambda t, c: t.groupBy("doc_id").agg(F.count(F.lit(1)).alias(c))
    j = catalog.where("status = 'indexed' AND chunk_count >= 1").join(count(vectors, "n_vectors"), "doc_id").join(count(postings, "n_postings"), "doc_id")
    return j.where("chunk_count = n_vectors AND chunk_count = n_postings").select(*catalog.columns)


def fallback_outcome(failure: Column, total: Column) -> Column:
    """What an answer from retrieval alone amounts to: retrieval_only, degraded after a failure, error without hits."""
    return F.when(total == 0, "error").when(failure.isNull(), "retrieval_only").otherwise("degraded")


def subtask_view(metadata: Column, data: Column, keys: dict[str, str]) -> list[Column]:
    """Chosen keys of a subtask: from its metadata, else its data, else a default."""
    return [F.coalesce(metadata[k], data[k], F.lit(v)).alias(k) for k, v in keys.items()]


def distinct_ids(ids: Column, most: int = 100, chars: int = 500) -> Column:
    """The first ``most`` distinct ids in order, each cut at ``chars``; blank ones go."""
    return F.slice(F.array_distinct(F.filter(F.transform(ids, lambda i: F.substring(i, 1, chars)), lambda i: F.coalesce(i, F.lit("")) != "")), 1, most)


def report_sections(reports: DataFrame, most: int = 12) -> DataFrame:
    """(report_id, section, title, content): sections under headings of up to three marks; empty ones go.

    A report without a heading is one section without a title; the first ``most`` stay.
    """
    heading = "(?m)^#{1,3}[ \\t]+(.{2,200}?)[ \\t]*$"
    parts = F.split("report", heading)
    titles = F.regexp_extract_all("report", F.lit(heading), F.lit(1))
    whole = F.array(F.struct(F.lit("").alias("title"), F.col("report").alias("content")))
    each = F.transform(F.sequence(F.lit(1), F.size(titles)), lambda i: F.struct(F.trim(F.element_at(titles, i)).alias("title"), F.regexp_replace(F.element_at(parts, i + 1), "^\\s+|\\s+$", "").alias("content")))
    found = F.when(F.size(titles) == 0, whole).otherwise(F.slice(F.filter(each, lambda s: s["content"] != ""), 1, most))
    return reports.select("report_id", F.posexplode(found).alias("section", "s")).select("report_id", "section", "s.title", "s.content")


def artifacts(outputs: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """Grounded, sourced and not empty outputs as artifacts with their freshness, the first ``most`` of a run.

    outputs: (run_id, position, title, content, success, grounding, n_sources).
    """
    good = outputs.where(F.col("success") & F.col("grounding").isin("grounded", "not_required") & (F.col("n_sources") > 0) & (F.trim("content") != ""))
    kind, until = freshness(F.concat_ws("\n", "title", "content"), now)
    w = Window.partitionBy("run_id").orderBy("position")
    a = good.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
    return a.select("run_id", "rank", "title", F.substring(F.trim("content"), 1, 50_000).alias("content"), kind.alias("freshness"), until.alias("expires_at"))


def root_status(outcome: Column, success: Column, error: Column) -> Column:
    """A root span's status from its run: error, warning for degraded ones, cancelled, or success."""
    return F.when(outcome == "cancelled", "cancelled").when(~success | error.isNotNull(), "error").when(outcome == "degraded", "warning").otherwise("success")


def guardrails(score: dict[str, Column], deep: Column, chars: Column, least: Column, has_markers: Column, has_sources: Column, invalid: Column) -> tuple[dict[str, Column], Column]:
    """A critic's scores under deterministic caps, and the rules that were broken, in order."""
    short = deep & least.isNotNull() & (chars < F.greatest(F.lit(1600), F.floor(least * F.lit(0.75))))
    missing, unbacked = has_sources & ~has_markers, ~has_sources & has_markers
    cap = lambda rule, most: F.when(rule, F.lit(float(most)))
    caps = {
        "completeness": [cap(short, 5.5)],
        "depth": [cap(short, 5.0)],
        "accuracy": [cap(invalid | unbacked, 5.0)],
        "citations": [cap(missing, 2.0), cap(invalid | unbacked, 0.0)],
        "overall": [cap(short, 5.5), cap(missing, 6.0), cap(invalid | unbacked, 5.0)],
    }
    capped = {k: F.least(v, *caps[k]) if k in caps else v for k, v in score.items()}
    names = F.array(F.when(short, "insufficient_depth"), F.when(missing, "missing_citations"), F.when(invalid, "invalid_citations"), F.when(unbacked, "unbacked_citations"))
    return capped, F.array_compact(names)


def flat_usage(usage: Column, nested: list[str]) -> Column:
    """Usage counts as one map of whole numbers, those of nested maps with their key as prefix.

    usage: struct with the map ``counts`` and maps of the nested keys.  Cached prompt tokens
    are also told as prompt_cache_hit_tokens, unless that is given.
    """
    whole = lambda m, head: F.transform_keys(F.transform_values(F.coalesce(m, F.create_map().cast("map<string,double>")), lambda k, v: v.cast("long")), lambda k, v: F.concat(F.lit(head), k))
    flat = F.map_concat(whole(usage["counts"], ""), *[whole(usage[k], k + "_") for k in nested])
    cached = F.coalesce(flat["prompt_tokens_details_cached_tokens"], flat["input_tokens_details_cached_tokens"], F.lit(0))
    more = F.when((cached > 0) & flat["prompt_cache_hit_tokens"].isNull(), F.create_map(F.lit("prompt_cache_hit_tokens"), cached)).otherwise(F.create_map().cast("map<string,bigint>"))
    return F.map_concat(flat, more)


def interleaved(rows: DataFrame, by: str, order: list[str], text: str, total: int, share: float = 0.4) -> DataFrame:
    """Adds taken: texts in turn until ``total`` characters of a group are used, each at most ``share`` of them."""
    return budget_fold(rows, by, order, text, total, int(total * share))


def union_hits(*hits: DataFrame) -> DataFrame:
    """Hits of several searches under each other, with the number of their search; copies stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [h.withColumn("search", F.lit(n)) for n, h in enumerate(hits)])


def merged_summary(model: DataFrame, fallback: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field from the model's summary where that is accepted and not blank, else from the fallback."""
    m = model.select(key, "accepted", *[F.col(f).alias("__" + f) for f in fields])
    use = lambda f: F.when(F.coalesce(F.col("accepted"), F.lit(False)) & (F.trim("__" + f) != ""), F.col("__" + f)).otherwise(F.col(f)).alias(f)
    return fallback.join(m, key, "left").select(key, *[use(f) for f in fields])
