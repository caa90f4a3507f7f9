"""Sources out of search payloads of unknown shape: every object with a URL, however deep, and links in the text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Links in text, fields of a source, titles that say nothing.
LINK = re.compile(r"\[([^\]]{1,300})\]\((https?://[^)\s]+)\)", re.IGNORECASE)
RAW = re.compile(r"https?://[^\s<>()\[\]{}\"']+", re.IGNORECASE)
URL_FIELDS = ("url", "uri", "link")
TITLE_FIELDS = ("title", "media")
GENERIC = ["", "untitled", "web", "web source"]
NO_TITLE = "Web source"
#: A scalar or a mark of JSON, and white space before it.
TOKEN = re.compile(r"\s*+(?:([{}\[\],:])|(\"(?:[^\"\\\x00-\x1f]|\\.)*+\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-]))", re.DOTALL)


def sources_of(payload: str | None) -> list[tuple[int, str, str]] | None:
    """(place, title, URL) of every object of a JSON text that has a URL, in the order of their begins; None if it is no JSON.

    Objects may be nested to any depth: the text is read once, by marks, with a list for a stack.
    """
    stack: list[list] = []  # of each open object or list: [kind, place, fields, key, whether it holds something]
    found: list[tuple[int, str, str]] = []
    at, done, text = 0, False, payload or ""
    wants = "value"
    while m := TOKEN.match(text, at):
        mark, string, scalar = m.groups()
        start, at = m.start() + len(m[0]) - len(m[0].lstrip()), m.end()
        if done:
            return None
        value, ended = None, False
        if mark in ("{", "["):
            if wants not in ("value", "value or end"):
                return None
            stack.append([mark, start, {}, None, False])
            wants = "key or end" if mark == "{" else "value or end"
            continue
        if mark in ("}", "]"):
            if not stack or stack[-1][0] != {"}": "{", "]": "["}[mark] or wants not in ("comma", "key or end", "value or end"):
                return None
            kind, place, fields, _, value = stack.pop()
            if kind == "{":
                url, title = (next((fields[f] for f in names if fields.get(f)), None) for names in (URL_FIELDS, TITLE_FIELDS))
                if url:
                    found.append((place, title if isinstance(title, str) else NO_TITLE, url if isinstance(url, str) else ""))
            ended = True
        elif mark == ",":
            if wants != "comma" or not stack:
                return None
            wants = "key" if stack[-1][0] == "{" else "value"
            continue
        elif mark == ":":
            if wants != "colon":
                return None
            wants = "value"
            continue
        elif string is not None:
            try:
                value = json.loads(string, strict=False)
            except ValueError:
                return None
            if wants in ("key", "key or end"):
                stack[-1][3], wants = value, "colon"
                continue
            ended = True
        else:
            value, ended = json.loads(scalar), True
        if ended:
            if wants not in ("value", "value or end") and mark is None:
                return None
            if not stack:
                done = True
            else:
                stack[-1][4] = True
                if stack[-1][0] == "{":
                    stack[-1][2][stack[-1][3]] = value if isinstance(value, str) else bool(value)
            wants = "comma"
    return sorted(found) if done and not text[at:].strip() else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ordinal, title, url, block) of batches of (id, payload, text)."""
    for b in batches:
        out: list[tuple] = []
        for n, (payload, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            text = text or ""
            links = [(t.strip() or NO_TITLE, u) for t, u in LINK.findall(text)]
            told = [(t, u) for _, t, u in sources_of(payload) or []] + links + [(NO_TITLE, u) for u in RAW.findall(text)]
            out += [(n, k, t, u, None) for k, (t, u) in enumerate(told)]
            blocks = [x.strip() for x in re.split(r"\n\s*\n", text)]
            k = len(told)
            for block in blocks:
                for u in [u for _, u in LINK.findall(block)] + RAW.findall(block):
                    out.append((n, k, None, u, block))
                    k += 1
        of, ordinal, title, url, block = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(ordinal, pa.int64()), pa.array(title, pa.string()), pa.array(url, pa.string()), pa.array(block, pa.string())], ["id", "ordinal", "title", "url", "block"])


def source_url(url: Column) -> Column:
    """A web address without what punctuation ends it and without a search's own fragment; empty if it has no host, or a user."""
    raw = F.regexp_replace(F.trim(url), "[.,;:!?]+$", "")
    good = raw.rlike("^(?i:https?)://[^/?#@:\\s][^/?#@]*(?:[/?#]|$)")
    return F.when(good, F.regexp_replace(raw, "^([^#]*)#ws_call_id=.*$", "$1")).otherwise("")


def harvested(payloads: DataFrame, most: int, id_col: str = "id", payload_col: str = "payload", text_col: str = "text") -> DataFrame:
    """(id, index, title, url, content) of (id, payload, text): the first ``most`` sources of each payload.

    A source counts once for each URL, at its first place: objects of the payload in the
    order of their begins, then links of the text, then bare addresses.  Its title is the first that says something, or else made of
    the URL by the caller; content are the text's blocks that name the URL, up to 4,000
    characters.  A payload that is no JSON, or null, has the sources of its text only.
    """
    kind = dict(payloads.dtypes)[id_col]
    rows = payloads.select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_candidates, f"id {kind}, ordinal long, title string, url string, block string")
    found = found.withColumn("url", source_url(F.col("url"))).where("url <> ''").withColumn("title", F.substring(F.trim("title"), 1, 500))
    says = F.when(F.col("block").isNull() & ~F.lower(F.trim("title")).isin(GENERIC), F.col("ordinal"))
    folded = lambda a, x: F.when(a == "", F.substring(x, 1, 4000)).when(a == x, a).otherwise(F.substring(F.concat(a, F.lit("\n\n"), x), 1, 4000))
    blocks = F.transform(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("ordinal", "block")))), lambda s: s["block"])
    by = found.groupBy("id", "url").agg(F.min(F.when(F.col("block").isNull(), F.col("ordinal"))).alias("first"), F.min_by("title", says).alias("title"), blocks.alias("blocks"))
    by = by.where("first IS NOT NULL").withColumn("content", F.aggregate("blocks", F.lit(""), folded))
    by = by.withColumn("index", F.row_number().over(Window.partitionBy("id").orderBy("first"))).where(F.col("index") <= most)
    return by.select(F.col("id").alias(id_col), F.col("index").cast("long").alias("index"), F.coalesce("title", F.lit("")).alias("title"), "url", "content")
