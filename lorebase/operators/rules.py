"""Running budgets, sections, admission, band joins, and small coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sections(lines: DataFrame, by: str, heading: Column) -> DataFrame:
    """Adds section: 0 before the first heading, then the heading's number."""
    w = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(heading.cast("int")).over(w))


def evict(entries: DataFrame, by: str, score: str, size: str, tie: str, capacity: int) -> DataFrame:
    """Adds kept: entries go from the lowest score up while what is left is over ``capacity``."""
    w = Window.partitionBy(by)
    before = F.coalesce(F.sum(size).over(w.orderBy(score, tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("kept", F.sum(size).over(w) - before <= capacity)


def cut_to_budget(rows: DataFrame, by: str, order: list[Column], text: str, budget: int, mark: str = "") -> DataFrame:
    """Adds taken: a row's text as far as the group's characters last; later rows get none.

    The text that is cut ends with ``mark``.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    room = F.greatest(F.lit(0), F.lit(budget) - before)
    cut = (room > 0) & (F.length(text) > room)
    return rows.withColumn("taken", F.concat(F.substring(F.col(text), F.lit(1), room.cast("int")), F.when(cut, mark).otherwise("")))


def admit(calls: DataFrame, run: str, turn: str, order: list[str], per_round: int, total: int) -> DataFrame:
    """Adds admitted: the first ``per_round`` calls of a round, ``total`` such calls of a run."""
    first = F.row_number().over(Window.partitionBy(run, turn).orderBy(*order)) <= per_round
    ranked = calls.withColumn("__first", first)
    upto = Window.partitionBy(run).orderBy(turn, *order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("admitted", F.col("__first") & (F.sum(F.col("__first").cast("int")).over(upto) <= total)).drop("__first")


def band_pairs(rows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Pairs (a, b) of ids of one key with 0 <= at_b - at_a <= width, a before b.

    ``at`` is a whole number.  Rows meet in cells of the band's width: a row is in its own
    cell and asks the next one as well, so the join is on equal keys and cells.
    """
    left = rows.select(F.col(key).alias("k"), F.col("id").alias("a"), F.col(at).alias("x"), F.explode(F.array(F.floor(F.col(at) / width), F.floor(F.col(at) / width) + 1)).alias("cell"))
    right = rows.select(F.col(key).alias("k"), F.col("id").alias("b"), F.col(at).alias("y"), F.floor(F.col(at) / width).alias("cell"))
    ahead = (F.col("y") > F.col("x")) | ((F.col("y") == F.col("x")) & (F.col("b") > F.col("a")))
    return left.join(right, ["k", "cell"]).where(ahead & (F.col("y") - F.col("x") <= width)).select("k", "a", "b")


def coerce_weight(value: Column) -> Column:
    """A finite number clamped to 0..1; 1 for anything else."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def show_duration(ms: Column) -> Column:
    """Milliseconds under a second, seconds under a minute, minutes and seconds above."""
    seconds = F.floor(ms / 1000).cast("long")
    return (
        F.when(ms < 1000, F.concat(F.floor(ms).cast("long").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("long").cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
    )


def safe_name(name: Column, most: int = 80) -> Column:
    """Letters, digits, dot, dash and underscore; others become one underscore; no leading dots."""
    clean = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^\\.+", "")
    return F.when(clean == "", F.lit("file")).otherwise(F.substring(clean, 1, most))


def show_cost(usd: Column, status: Column, names: dict[str, str]) -> Column:
    """A cost in dollars, six digits under a cent; what ``names`` says of a status without one; + for a partial one."""
    money = F.concat(F.lit("$"), F.when(usd < 0.01, F.format_string("%.6f", usd)).otherwise(F.format_string("%.3f", usd)))
    return F.coalesce(*[F.when(status == k, v) for k, v in names.items()], F.when(status == "partial", F.concat(money, F.lit("+"))), money)


def show_count(n: Column) -> Column:
    """A whole number with commas; a dash for negative ones."""
    return F.when(n < 0, "—").otherwise(F.format_number(n, 0))


def needs_ocr(text: Column, least: int, ratio: float) -> tuple[Column, Column]:
    """Characters that aren't white space, and whether they are too few or too seldom printable."""
    solid = F.regexp_replace(text, "\\s", "")
    printable = F.length(F.regexp_replace(solid, "[\\p{C}]", ""))
    return F.length(solid), (F.length(solid) < least) | (printable / F.length(solid) < ratio)


def sampled(text: Column, budget: int, mark: str = "\n\n[...]\n\n") -> Column:
    """A text up to ``budget`` characters whole; else 3 to 8 segments at even distances, joined by ``mark``."""
    n = min(8, max(3, budget // 1000))
    size = max(1, (budget - len(mark) * (n - 1)) // n)
    last = F.greatest(F.lit(0), F.length(text) - size)
    parts = [F.substring(text, F.bround(last * k / F.lit(float(n - 1))).cast("int") + 1, F.lit(size)) for k in range(n)]
    return F.when(F.length(text) <= budget, text).otherwise(F.substring(F.concat_ws(mark, *parts), 1, budget))


def refinement_accepted(before: Column, after: Column, total: float, each: float) -> Column:
    """Whether scores after a refinement are kept: their sum falls by ``total`` at most, none by over ``each``."""
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    falls = F.zip_with(before, after, lambda x, y: F.round(x - y, 6))
    return (F.round(sum_of(after) - sum_of(before), 6) >= -total) & ~F.exists(falls, lambda x: x > each)
