"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import SPACE, written

#: A size class is the number of binary digits of a document's size; classes 0 to 63.
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A draw in (0, 1) keyed by seed and key: 52 bits of an MD5 digest."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """(source, source_size, target) of (source, source_size): water filling under the cap.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes.  A target stops at ``cap`` times its source's size and the excess is shared
    anew.  In order of cap / weight, the first sources reach their cap; the others share
    what is left by weight, which is where the repeated resharing ends.
    The table has a row for each source; the window runs over these rows only.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    w = sizes.withColumn("__w", turn).withColumn("__limit", F.lit(float(cap)) * F.col("source_size"))
    every = Window.partitionBy(F.lit(1))
    rank = Window.partitionBy(F.lit(1)).orderBy((F.col("__limit") / F.col("__w")), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("__all", F.sum("source_size").over(every).cast("double"))
    w = w.withColumn("__rest", F.col("__all") - F.coalesce(F.sum("__limit").over(rank), F.lit(0.0)))
    w = w.withColumn("__weight", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(rank), F.lit(0.0)))
    # a source is full if its share of the rest reaches its limit; full ones come first
    w = w.withColumn("__full", F.col("__rest") * F.col("__w") >= F.col("__limit") * F.col("__weight"))
    level = F.first(F.when(~F.col("__full"), F.struct("__rest", "__weight")), ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy((F.col("__limit") / F.col("__w")), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("__level", level)
    target = F.when(F.col("__full"), F.col("__limit")).otherwise(F.col("__level.__rest") * F.col("__w") / F.col("__level.__weight"))
    return w.select("source", "source_size", target.alias("target"))


def copies(classes: DataFrame, cap: float, tilt: float) -> DataFrame:
    """Expected copies m of a document by (source, class): min(cap, c * 2 ** (-tilt * class)).

    c is set for each source so that the expected words are its target.  The classes that
    reach the cap are the smallest ones, so c follows from sums over a source's classes,
    of which there are 64 at most.
    """
    by = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    of = Window.partitionBy("source")
    x = classes.withColumn("__f", F.pow(F.lit(2.0), F.lit(-tilt) * F.col("class")))
    x = x.withColumn("__mass", F.col("__f") * F.col("words"))
    x = x.withColumn("__need", F.col("target") - F.lit(cap) * F.coalesce(F.sum("words").over(by), F.lit(0)))
    x = x.withColumn("__over", F.sum("__mass").over(of) - F.coalesce(F.sum("__mass").over(by), F.lit(0.0)))
    x = x.withColumn("__full", F.col("__need") * F.col("__f") >= F.lit(cap) * F.col("__over"))
    c = F.first(F.when(~F.col("__full"), F.col("__need") / F.col("__over")), ignorenulls=True).over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x.withColumn("__c", c).select("source", "class", "source_size", "target", F.when(F.col("__full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("__c") * F.col("__f"))).alias("m"))


def plan(rows: DataFrame, cap: float, weights: tuple[float, ...], tilt: float, seed: int, buckets: int) -> DataFrame:
    """One row for each source: sizes, target, copies by class, and where the sample is cut.

    ``rows`` has __id, __source, __size.  __cut is the key range in which the source's words
    run out, __ahead the sampled words of the ranges before it, __left the words to sample.
    """
    rows = rows.withColumn("class", _size_class(F.col("__size")))
    by_class = rows.groupBy(F.col("__source").alias("source"), "class").agg(F.sum("__size").alias("words"))
    by_class = written(by_class, "mix-classes")
    shares = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), cap, weights)
    shares = shares.withColumnRenamed("source", "__s")
    m = copies(by_class.join(shares, F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), cap, tilt)
    sources = written(
        m.groupBy("source").agg(F.first("source_size").alias("__source_size"), F.first("target").alias("__target"), F.map_from_entries(F.collect_list(F.struct("class", "m"))).alias("__m")).withColumnRenamed("source", "__s"),
        "mix-sources",
    )
    x = _keyed(rows.join(sources, F.col("__source").eqNullSafe(F.col("__s"))), seed, buckets)
    bins = x.groupBy("__s", "__bin").agg(F.sum("__size").alias("__n"), F.sum(F.col("__size") * F.col("__whole")).alias("__w"))
    of = Window.partitionBy("__s")
    upto = of.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).withColumn("__sure", F.sum("__w").over(of))
    left = F.round("__target").cast("long") - F.col("__sure")
    bins = bins.withColumnRenamed("__s", "__s2").join(sources, F.col("__s2").eqNullSafe(F.col("__s"))).withColumn("__left", left)
    cut = bins.where((F.col("__bin") < buckets) & (F.col("__before") + F.col("__n") > F.col("__left")))
    cut = cut.groupBy("__s2").agg(F.min(F.struct("__bin", "__before", "__left")).alias("c"))
    out = sources.join(cut, F.col("__s").eqNullSafe(F.col("__s2")), "left")
    return written(out.select("__s", "__source_size", "__target", "__m", F.coalesce("c.__bin", F.lit(buckets)).alias("__cut"), F.col("c.__before").alias("__ahead"), F.col("c.__left").alias("__left")), "mix-plan")


def _size_class(size: Column) -> Column:
    return F.when(size > 0, F.length(F.conv(size.cast("string"), 10, 2))).otherwise(0).cast("int")


def _keyed(x: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Adds certain copies, the Pareto key and its range to rows that hold __m, __id, __size."""
    m = F.element_at("__m", _size_class(F.col("__size")))
    x = x.withColumn("__copies", m).withColumn("__whole", F.floor("__copies").cast("long"))
    x = x.withColumn("__p", F.col("__copies") - F.col("__whole")).withColumn("__u", uniform(F.col("__id"), seed))
    key = F.col("__u") * (1 - F.col("__p")) / ((1 - F.col("__u")) * F.col("__p"))
    x = x.withColumn("__q", F.when(F.col("__p") > 0, key))
    # q / (1 + q) rises with the key and lies between 0 and 1
    at = F.least(F.floor(F.col("__q") / (1 + F.col("__q")) * buckets), F.lit(buckets - 1))
    return x.withColumn("__bin", F.coalesce(at, F.lit(buckets)).cast("int"))


def take(rows: DataFrame, sources: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Adds taken to ``rows`` (__id, __source, __size, __tie and any others).

    Rows outside their source's cut range need no shuffle.
    """
    x = _keyed(rows.join(sources, F.col("__source").eqNullSafe(F.col("__s"))), seed, buckets)
    sure = F.col("__size") * F.col("__whole")
    off = x.where(F.col("__bin") != F.col("__cut")).withColumn("taken", sure + F.when(F.col("__bin") < F.col("__cut"), F.col("__size")).otherwise(0))
    at = x.where((F.col("__bin") == F.col("__cut")) & (F.col("__cut") < buckets))
    rank = Window.partitionBy("__s").orderBy("__q", "__id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("__run", F.col("__ahead") + F.coalesce(F.sum("__size").over(rank), F.lit(0)))
    at = at.withColumn("taken", sure + F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__left") - F.col("__run")))).drop("__run")
    last = x.where((F.col("__bin") == buckets) & (F.col("__cut") == buckets)).withColumn("taken", sure)
    return off.unionByName(at).unionByName(last)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), tilt: float = 0.125, seed: int = 11, buckets: int = 4096) -> DataFrame:
    """Add size, source_size, target and taken (words that the mix takes) to every row.

    A document's expected number of copies m falls gently with its size class (``tilt``), is
    ``cap`` at most, and sums to its source's target in words.  floor(m) copies are certain.
    The rest of m is an inclusion probability p; documents are ranked by the Pareto order
    key u (1 - p) / ((1 - u) p), with u keyed by seed and id, and a source takes documents
    in that order until its words are used up: the sample's size in words is fixed.  The
    document at the cut gives only the words still needed, so a source's taken words differ
    from its target by rounding alone.  Ties in the key go by id, then by a digest of the
    text; rows equal in both are served one after the other.

    Null texts and texts without a word have size 0 and take 0; a null source is a source
    of its own; an empty table gives an empty result; a source of size 0 has target 0.
    Other columns stay, those of the four names are replaced.

    Words of ``buckets`` key ranges of a source are added up first; a running sum over rows
    is needed only in the one range where the source's words run out.
    """
    given = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken"}]
    out = _mixed(docs, given, id_col, text_col, source_col, cap, weights, tilt, seed, buckets)
    return out.select(*[F.col("__given").getField(c).alias(c) for c in given], F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("taken").cast("long").alias("taken"))


def _mixed(docs: DataFrame, given: list[str], id_col: str, text_col: str, source_col: str, cap: float, weights: tuple[float, ...], tilt: float, seed: int, buckets: int) -> DataFrame:
    """:func:`take` with the given columns in one struct, __given, whose names clash with none."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("__given"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"), F.xxhash64(text_col).alias("__tie"))
    narrow = written(rows.select("__id", "__source", "__size", "__tie"), "mix-sizes")
    return take(rows, plan(narrow, cap, weights, tilt, seed, buckets), seed, buckets)


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), tilt: float = 0.125, seed: int = 11, buckets: int = 4096) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it; all columns as they came.

    The document at a source's cut, of which a part is taken, stays if that is over half.
    Texts without a word are taken 0 times.
    """
    out = _mixed(docs, docs.columns, id_col, text_col, source_col, cap, weights, tilt, seed, buckets)
    times = F.when(F.col("__size") > 0, F.round(F.col("taken") / F.col("__size"))).otherwise(0).cast("int")
    out = out.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return out.select(*[F.col("__given").getField(c).alias(c) for c in docs.columns])


def mix_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), tilt: float = 0.125, seed: int = 11, buckets: int = 4096) -> DataFrame:
    """As :func:`mix`, but with the id as the only column kept: texts are read once."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"), F.xxhash64(text_col).alias("__tie"))
    narrow = written(rows, "mix-sizes")
    out = take(narrow, plan(narrow, cap, weights, tilt, seed, buckets), seed, buckets)
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("taken").cast("long").alias("taken"))
