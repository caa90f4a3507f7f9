"""Records as they are stored and shown: points, hits, URLs, times, assets, spans, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import point_id

# What credentials look like, in names and in texts.
SECRET_NAME = "(?i)(api[_-]?key|authorization|password|passwd|secret|token|cookie)"
SECRET_TEXT = "(?i)\\b(?:sk|pk|ghp|github_pat|Bearer)[-_A-Za-z0-9.]{8,}"


def redacted(text: Column, most: int = 20_000) -> Column:
    """A text without credentials, cut at ``most`` characters."""
    return F.substring(F.regexp_replace(text, SECRET_TEXT, "[REDACTED]"), 1, most)


def redacted_fields(fields: Column, most: int = 20_000) -> Column:
    """A map of texts: values of secret names go whole, others lose their credentials."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SECRET_NAME), "[REDACTED]").otherwise(redacted(v, most)))


def built_points(chunks: DataFrame, vectors: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Points (id, vector, doc_id, chunk_id) of chunks and their vectors, and the chunks that have no sound vector.

    chunks: (doc_id, chunk_no, chunk_id), vectors: (doc_id, chunk_no, vector).
    """
    j = chunks.join(vectors, ["doc_id", "chunk_no"], "left")
    sound = F.coalesce(F.size("vector") == width, F.lit(False))
    good = j.where(sound).select(point_id(F.col("chunk_id")).alias("id"), "vector", "doc_id", "chunk_id")
    return good, j.where(~sound).select("doc_id", "chunk_no", F.when(F.col("vector").isNull(), "missing").otherwise("width").alias("problem"))


def hits(points: DataFrame) -> DataFrame:
    """Payloads as hits: (chunk_id, doc_id, content, source, page); those without a chunk id go."""
    p = F.col("payload")
    return points.select(p["chunk_id"].alias("chunk_id"), p["doc_id"].alias("doc_id"), F.coalesce(p["content"], p["text"], F.lit("")).alias("content"), F.coalesce(p["source"], F.lit("vector")).alias("source"), p["page"].cast("int").alias("page")).where("chunk_id IS NOT NULL")


def public_url(url: Column, web_only: bool = True, keep_slash: bool = False) -> Column:
    """A URL without user, query and fragment; empty if it has no host, or is no web address."""
    part = lambda n: F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", n)
    scheme, path = F.lower(part(1)), part(3) if keep_slash else F.regexp_replace(part(3), "/+$", "")
    bad = (part(2) == "") | (part(2).startswith(":"))
    if web_only:
        bad = bad | ~scheme.isin("http", "https")
    return F.when(bad, "").otherwise(F.concat(scheme, F.lit("://"), F.lower(part(2)), path))


def utc_text(at: Column) -> Column:
    """A time in UTC as text that ends with Z."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def asset_name(name: Column, most: int = 160) -> Column:
    """A file name without path: other characters than letters, digits, dot, dash and underscore become underscores.

    Dots and underscores at its ends go; source when nothing is left.
    """
    last = F.regexp_extract(name, "([^/\\\\]*)$", 1)
    clean = F.substring(F.regexp_replace(F.regexp_replace(last, "[^\\p{L}\\p{N}._-]", "_"), "^[._]+|[._]+$", ""), 1, most)
    return F.when(clean == "", "source").otherwise(clean)


def asset_key(doc: Column, name: Column) -> Column:
    """Where an asset lies: under its document's id, which must be lower-case hex; null for any other."""
    return F.when(doc.rlike("^[0-9a-f]+$"), F.concat_ws("/", doc, asset_name(name)))


def exported_spans(spans: DataFrame, most: int, chars: int) -> DataFrame:
    """The first ``most`` spans of each trace by start, names cut at ``chars``, and how many were left out."""
    w = Window.partitionBy("trace_id")
    s = spans.withColumn("position", F.row_number().over(w.orderBy("start_time", "span_id")).cast("long")).withColumn("left_out", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)))
    return s.where(F.col("position") <= most).select("trace_id", "span_id", F.substring("name", 1, chars).alias("name"), "position", "left_out")


def preference(text: Column, patterns: list[str], veto: str, most: int = 500) -> Column:
    """A stated preference: what the first pattern that fits matches, cut; null if the text is sensitive."""
    found = F.coalesce(*[F.when(text.rlike(p), F.substring(F.trim(F.regexp_extract(text, p, 0)), 1, most)) for p in patterns])
    return F.when(~text.rlike(veto), found)


def source_labels(sources: Column, task: Column) -> Column:
    """What a stored fact names as its sources: URL, else title, else source of each, else the task."""
    label = F.transform(sources, lambda s: F.coalesce(F.nullif(s["url"], F.lit("")), F.nullif(s["title"], F.lit("")), F.nullif(s["source"], F.lit(""))))
    known = F.array_distinct(F.filter(label, lambda x: x.isNotNull()))
    return F.when(F.size(known) > 0, known).otherwise(F.array(task))


def model_for(role: Column, roles: DataFrame, provider_default: Column) -> Column:
    """The model set for a role, else the provider's default; ``roles`` was joined as role_model."""
    return F.coalesce(F.nullif(F.trim(F.col("role_model")), F.lit("")), provider_default)


def rendered(messages: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Adds line: messages as "role: text" in order, the last one cut, so that with line ends ``most`` characters last."""
    line = F.concat_ws(": ", "role", "text")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(most) - F.coalesce(F.sum(F.length(line) + 1).over(w), F.lit(0))
    return messages.withColumn("line", F.when(left > 0, F.substring(line, F.lit(1), left.cast("int")))).where("line IS NOT NULL")
