"""Queries on questions that compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.operators import comparisons as C
from lorebase.plans.registry import query, table

#: A question, whether it compares, what, and how many subtasks it needs at least; {a} and {b} are a part's name and brand.
TEMPLATES = [
    ("比较 {a} 和 {b}", True, "{a}", "{b}", 2),
    ("请对比{a}与{b}的性能", True, "{a}的性能", "{b}的性能", 2),
    ("{a} vs. {b} 有什么区别？", True, "{a}", "{b}", 2),
    ("{a} 和 {b} 应该怎么选", True, "{a}", "{b}", 2),
    ("{a} versus {b}", True, "{a}", "{b}", 2),
    ("{a} 与 {b}用于生产 哪个更合适？", True, "{a}", "{b}", 2),
    ("说明 {a}", False, None, None, 1),
    ("全面介绍 {a}", False, None, None, 3),
    ("{a} 为什么重要？如何使用？", False, None, None, 2),
    ("列出 {a}、{b}、价格", False, None, None, 3),
    ("介绍 {a}，以及 {b}", False, "介绍 {a}，以", "{b}", 2),
    ("比较 {a} 和 {a}", True, None, None, 2),
    ("", False, None, None, 1),
]


def _sql(template):
    return "NULL" if template is None else "'" + template.replace("{a}", "' || a || '").replace("{b}", "' || b || '") + "'"


def _expected():
    cases = [f"SELECT p_partkey, {c} AS compares, {_sql(x)} AS subject, {_sql(y)} AS other, {n}::INT AS least FROM p WHERE p_partkey % {len(TEMPLATES)} = {k}" for k, (_, c, x, y, n) in enumerate(TEMPLATES)]
    return "WITH p AS (SELECT p_partkey, p_name AS a, p_brand AS b FROM part) " + " UNION ALL ".join(cases)


@query("x25_comparisons", _expected())
def comparisons(spark, d):
    """Questions about the names and brands of parts, in thirteen forms; the SQL has what each form asks, told by hand."""
    k, task = F.col("p_partkey") % len(TEMPLATES), F.lit(None)
    for n, (t, *_) in enumerate(TEMPLATES):
        task = F.when(k == n, F.replace(F.replace(F.lit(t), F.lit("{a}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand"))).otherwise(task)
    t = table(spark, d, "part").select("p_partkey", task.alias("t"))
    s = t.select("p_partkey", C.is_comparison(F.col("t")).alias("compares"), C.comparison_subjects(F.col("t")).alias("s"), C.least_subtasks(F.col("t")).alias("least"))
    return s.select("p_partkey", "compares", F.col("s.left").alias("subject"), F.col("s.right").alias("other"), "least")
