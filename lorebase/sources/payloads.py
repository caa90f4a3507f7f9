"""Texts and payloads that come from outside: files by suffix, JSON lines, catalogs, search results, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes that are parsed, and how.
FORMATS = {".pdf": "pdf", ".docx": "docx", ".html": "html", ".htm": "html", ".md": "markdown", ".txt": "text"}


def file_format(name: Column) -> Column:
    """How a file of a name is parsed; null for other suffixes."""
    suffix = F.lower(F.regexp_extract(name, "(\\.[^./\\\\]+)$", 1))
    return F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.lit(v))])[suffix]


def file_problem(name: Column, size: Column, text: Column, most_bytes: int, most_chars: int) -> Column:
    """Why a file is refused: unsupported, too_large, empty or too_long; null if it is taken."""
    return F.when(file_format(name).isNull(), "unsupported").when(size > most_bytes, "too_large").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(F.length(text) > most_chars, "too_long")


def read_texts(files: DataFrame) -> DataFrame:
    """(path, text, encoding) of binaryFile rows: UTF-8 if valid, else latin-1, which takes any bytes."""
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"), F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"))


def span_lines(lines: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """(by, span_id, name, tokens, position): JSON lines of spans; broken ones are passed over, ``most`` of a trace stay."""
    span = F.from_json("line", "span_id long, name string, tokens long")
    s = lines.withColumn("s", span).where("s.span_id IS NOT NULL").withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    return s.where(F.col("position") <= most).select(by, "s.span_id", "s.name", "s.tokens", "position")


def model_catalog(payloads: DataFrame, most: int) -> DataFrame:
    """(provider, id, owner, position) of (provider, payload): models under data, models or as a list.

    Entries are objects (id, name or model; owned_by or owner) or plain names; blank ones go,
    the first of each id stays, and the first ``most`` by lower-case id are kept.
    """
    entry = "array<struct<id:string,name:string,model:string,owned_by:string,owner:string>>"
    p = payloads.select("provider", F.from_json("payload", f"struct<data:{entry},models:{entry}>").alias("o"), F.when(F.ltrim("payload").startswith("["), F.from_json("payload", "array<string>")).alias("names"))
    plain = F.transform("names", lambda n: F.struct(n.alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("owned_by"), F.lit(None).cast("string").alias("owner")))
    e = p.select("provider", F.posexplode(F.coalesce("o.data", "o.models", plain)).alias("at", "e"))
    e = e.select("provider", "at", F.trim(F.coalesce(F.nullif("e.id", F.lit("")), F.nullif("e.name", F.lit("")), "e.model")).alias("id"), F.trim(F.coalesce(F.nullif("e.owned_by", F.lit("")), "e.owner", F.lit(""))).alias("owner")).where("id <> '' AND length(id) <= 512")
    one = e.groupBy("provider", "id").agg(F.min_by("owner", "at").alias("owner"))
    w = Window.partitionBy("provider").orderBy(F.lower("id"), "id")
    return one.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= most)


def search_results(html: Column, most: int) -> Column:
    """[(title, url, content)] of a result page: links are unwrapped, others than http are passed over."""
    blocks = F.slice(F.split(html, '<div class="result__body">'), 2, 1000)
    link = lambda b: F.replace(F.regexp_extract(b, '<a class="result__a" href="([^"]*)"', 1), F.lit("&amp;"), F.lit("&"))
    plain = lambda b, p: F.trim(F.regexp_replace(F.regexp_extract(b, p, 1), "<[^>]+>", ""))
    target = lambda u: F.when(u.contains("uddg="), F.url_decode(F.regexp_extract(u, "[?&]uddg=([^&]*)", 1))).otherwise(u)
    found = F.transform(blocks, lambda b: F.struct(plain(b, '<a class="result__a"[^>]*>(.*?)</a>').alias("title"), target(link(b)).alias("url"), plain(b, '<a class="result__snippet"[^>]*>(.*?)</a>').alias("content")))
    return F.slice(F.filter(found, lambda r: r["url"].rlike("^https?://[^/]")), 1, most)


def qa_blocks(text: Column) -> Column:
    """[(number, question, answer)] of blocks that begin with ### Q<number> and answer after **A:**."""
    blocks = F.regexp_extract_all(text, F.lit("(?s)###\\s*Q\\d+\\s*\\n.*?\\*\\*A:\\*\\*.*?(?=\\n###\\s*Q|\\z)"), F.lit(0))
    part = lambda b, n: F.trim(F.regexp_replace(F.regexp_extract(b, "(?s)^###\\s*Q(\\d+)\\s*\\n(.*?)\\*\\*A:\\*\\*\\s*(.*)$", n), "^\\s+|\\s+$", ""))
    return F.transform(blocks, lambda b: F.struct(part(b, 1).cast("int").alias("number"), part(b, 2).alias("question"), part(b, 3).alias("answer")))


def bounded_score(value: Column) -> Column:
    """A finite number held in 0 to 10; anything else is 0."""
    x = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.0), x)))


def scroll(points: DataFrame, condition: Column, fields: list[str], most: int) -> DataFrame:
    """Chosen fields of the points that meet a condition; more than ``most`` is an error, not a cut."""
    rows = points.where(condition).select(*fields)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} records")
    return rows
