"""Elements of parsed pages: tables, boxes, routing, metrics, and their order in a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_lines(text: Column) -> tuple[Column, Column]:
    """Lines that aren't blank, and those of them with two columns set apart by spaces or a tab."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.size(lines), F.size(F.filter(lines, lambda x: x.rlike("\\S(?:\\s{2,}|\\t)\\S")))


def looks_like_table(text: Column) -> Column:
    """Three lines or more, two or more of them aligned."""
    lines, aligned = table_lines(text)
    return (lines >= 3) & (aligned >= 2)


def edge_clusters(edges: Column, gap: float = 28.0) -> Column:
    """Clusters of sorted left edges: one begins over ``gap`` beyond the start of the one before."""
    first = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("start"))
    step = lambda s, e: F.when(s["start"].isNull() | (e - s["start"] > gap), F.struct((s["n"] + 1).alias("n"), e.alias("start"))).otherwise(s)
    return F.aggregate(F.array_sort(F.transform(edges, lambda e: e.cast("double"))), first, step, lambda s: s["n"])


def inside_any(x: Column, y: Column, boxes: Column) -> Column:
    """Whether a point lies in one of some boxes (x0, top, x1, bottom), edges included."""
    return F.exists(boxes, lambda b: x.between(b["x0"], b["x1"]) & y.between(b["top"], b["bottom"]))


def bounding_box(points: Column) -> Column:
    """(x0, top, x1, bottom) of points (two numbers) and boxes (four); null without any."""
    pairs = F.flatten(F.transform(points, lambda p: F.when(F.size(p) >= 4, F.array(F.slice(p, 1, 2), F.slice(p, 3, 2))).when(F.size(p) >= 2, F.array(F.slice(p, 1, 2))).otherwise(F.array().cast("array<array<double>>"))))
    xs, ys = F.transform(pairs, lambda p: p[0]), F.transform(pairs, lambda p: p[1])
    return F.when(F.size(pairs) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("top"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("bottom")))


def route_reasons(text: Column, needs_ocr: Column, has_images: Column) -> Column:
    """Why a page takes another route than native text, in fixed order."""
    formula = text.rlike("[\\x{00b1}\\x{00d7}\\x{00f7}\\x{2200}-\\x{22ff}\\x{27c0}-\\x{27ef}]")
    return F.array_compact(F.array(F.when(needs_ocr, "ocr_required"), F.when(has_images, "embedded_visual"), F.when(formula, "formula_candidate")))


def page_metrics(elements: DataFrame) -> DataFrame:
    """(doc_id, page, n_elements, n_tables, n_images, n_ocr, confidence) of (doc_id, page, kind, method, confidence)."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return elements.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_elements"), kind("table").alias("n_tables"), kind("image").alias("n_images"), F.count_if(F.col("method") == "ocr").alias("n_ocr"), F.avg("confidence").alias("confidence"))


def assembled(elements: DataFrame) -> DataFrame:
    """Adds begin and end: places in a document of elements in order of page, top, left, reading order and kind.

    Elements are joined by two characters; blank ones have no place; those without a box come last.
    """
    last = lambda c: F.col(c).asc_nulls_last()
    w = Window.partitionBy("doc_id").orderBy("page", last("top"), last("left"), "reading_order", "kind").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.trim("content") != "", F.length("content") + 2).otherwise(0)
    e = elements.withColumn("__begin", F.coalesce(F.sum(size).over(w), F.lit(0)))
    solid = F.trim("content") != ""
    return e.withColumn("begin", F.when(solid, F.col("__begin"))).withColumn("end", F.when(solid, F.col("__begin") + F.length("content"))).drop("__begin")


def markdown_table(rows: Column, most: int) -> Column:
    """(markdown, n_rows, n_columns) of a table given as rows of cells; null with over ``most`` cells.

    Rows without a cell that isn't blank go; white space runs become one space, bars are
    escaped, short rows are filled up with empty cells, and the first row is the heading.
    """
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")), F.lit("|"), F.lit("\\|"))
    kept = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(kept, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(kept, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    cells = F.aggregate(kept, F.lit(0), lambda s, r: s + F.size(r))
    text = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when((F.size(kept) > 0) & (cells <= most), F.struct(text.alias("markdown"), F.size(kept).alias("n_rows"), width.alias("n_columns")))


def kept_metadata(metadata: Column) -> Column:
    """Element metadata without the table's own payloads."""
    return F.map_filter(metadata, lambda k, v: ~k.isin("table_html", "table_cells"))
