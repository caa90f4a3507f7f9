"""Layout of pages from word boxes: words to lines and segments, columns, and blocks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, in points: least tolerance of a line and its share of the height; least gap between segments and how
# many times the word before; least gap between columns; most gap and least shift inside a block, and its share of the width.
LINE, HEIGHT, GAP, TIMES, COLUMN, BETWEEN, SHIFT, WIDTH = 2.5, 0.45, 32.0, 3.0, 72.0, 18.0, 72.0, 0.45

Line = tuple[float, float, float, float, str]  # x0, top, x1, bottom, content


def lines(words: list[Line]) -> list[Line]:
    """Lines, cut into segments at wide gaps: a word joins a line if its top is near the mean top of the line's words so far."""
    rows: list[list[Line]] = []
    total = height = 0.0
    for w in sorted(words, key=lambda w: (w[1], w[0])):
        if rows and abs(w[1] - total / len(rows[-1])) <= max(LINE, height * HEIGHT):
            rows[-1].append(w)
            total, height = total + w[1], max(height, w[3] - w[1])
        else:
            rows.append([w])
            total, height = w[1], w[3] - w[1]
    out = []
    for row in rows:
        segment: list[Line] = []
        for w in sorted(row, key=lambda w: w[0]):
            if segment and w[0] - segment[-1][2] > max(GAP, TIMES * max(segment[-1][2] - segment[-1][0], 1.0)):
                out.append(_joined(segment, " "))
                segment = []
            segment.append(w)
        out.append(_joined(segment, " "))
    return out


def _joined(parts: list[Line], by: str) -> Line:
    return min(p[0] for p in parts), min(p[1] for p in parts), max(p[2] for p in parts), max(p[3] for p in parts), by.join(p[4] for p in parts).strip()


def columns(segments: list[Line]) -> list[list[Line]]:
    """Lines in reading order: full-width ones, the left column, the right column; one column without a wide gap of begins."""
    ordered = sorted(segments, key=lambda s: (s[1], s[0]))
    begins = sorted(s[0] for s in ordered)
    if len(ordered) < 4:
        return [ordered]
    width, at = max(((b - a, -k) for k, (a, b) in enumerate(zip(begins, begins[1:], strict=False))))
    split = (begins[-at] + begins[1 - at]) / 2
    left = [s for s in ordered if s[0] < split and s[2] <= split]
    right = [s for s in ordered if s[0] >= split]
    if width < COLUMN or len(left) < 2 or len(right) < 2:
        return [ordered]
    return [[s for s in ordered if s[0] < split < s[2]], left, right]


def blocks(segments: list[Line]) -> list[tuple[Line, int]]:
    """(block, number of lines): neighbours in a column that are close and begin alike."""
    out = []
    for column in columns(segments):
        block: list[Line] = []
        for s in column:
            if block and (s[1] - block[-1][3] > BETWEEN or abs(s[0] - block[-1][0]) > max(SHIFT, WIDTH * max(block[-1][2] - block[-1][0], 1.0))):
                out.append((_joined(block, "\n"), len(block)))
                block = []
            block.append(s)
        if block:
            out.append((_joined(block, "\n"), len(block)))
    return out


def page_blocks(words: DataFrame, page_col: str = "page") -> DataFrame:
    """(page, block_no, content, x0, top, x1, bottom, n_lines) of word boxes (page, x0, top, x1, bottom, text).

    A page's words come to one task in order, and are laid out as they come; one page is held at a time.  Words without
    a text or a coordinate are passed over; words of equal place go by their text.
    """
    kind = dict(words.dtypes)[page_col]
    fields = ["x0", "top", "x1", "bottom", "text"]
    names = [page_col, "block_no", "content", "x0", "top", "x1", "bottom", "n_lines"]

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, page = None, []
        for b in itertools.chain(batches, [None]):
            done = []
            if b is None:
                done.append((now, page))
            else:
                of, kept = b.schema.field(0).type, list(zip(*[c.to_pylist() for c in b.columns[1:]], strict=True))
                pages = b.column(0).to_pylist()
                lo = 0
                for n, p in enumerate([*pages, None]):
                    if n == len(pages) or p != now:
                        page += kept[lo:n]
                        lo = n
                        if n < len(pages):
                            done.append((now, page))
                            now, page = p, []
            rows = [(p, k, c[4], *c[:4], n) for p, boxes in done if boxes for k, (c, n) in enumerate(blocks(lines(boxes)))]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [of, pa.int64(), pa.string(), *[pa.float64()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    told = words.select(page_col, *[F.col(f).cast("double").alias(f) for f in fields[:4]], "text").dropna(subset=fields)
    dealt = told.repartition(page_col).sortWithinPartitions(page_col, "top", "x0", "text")
    return dealt.mapInArrow(laid_out, f"`{page_col}` {kind}, block_no long, content string, x0 double, top double, x1 double, bottom double, n_lines long")
