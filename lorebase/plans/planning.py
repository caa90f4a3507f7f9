"""Queries on plans: an order is a plan, its lines are tasks that wait for earlier lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.operators import graph as G
from lorebase.operators import planning as P
from lorebase.plans.registry import query, table

# a line's task waits for lines before it that ship no later; some lines break a rule
TASKS = """l AS (SELECT l_orderkey AS plan_id, l_linenumber AS n, l_quantity AS q, l_shipdate AS d, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) AS twin FROM lineitem),
u AS (SELECT *, CASE WHEN q = 3 THEN '' ELSE 't' || n END AS task FROM l WHERE twin = 1 OR q < 10),
tasks AS (SELECT a.plan_id, a.n, a.task, a.q, a.p, CASE WHEN a.q = 4 THEN ' ' ELSE 'part ' || a.p END AS description, CASE a.p % 50 WHEN 7 THEN 'poem' ELSE 'research' END AS task_type, (a.q % 11)::INT AS priority,
  list_concat(coalesce((SELECT list(DISTINCT 't' || b.n ORDER BY 't' || b.n) FROM l b WHERE b.plan_id = a.plan_id AND b.twin = 1 AND b.n < a.n AND b.d <= a.d), []), CASE WHEN a.q = 5 THEN ['t' || a.n] WHEN a.q = 6 THEN ['t99'] WHEN a.q = 7 THEN [' '] WHEN a.q = 8 AND a.n = 1 THEN ['t2'] ELSE [] END) AS deps FROM u a)"""


def _tasks(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_shipdate").alias("d"), F.col("l_partkey").alias("p"), "l_extendedprice").repartition("plan_id")  # noqa: E741
    l = l.withColumn("twin", F.row_number().over(Window.partitionBy("plan_id", "n").orderBy("p", "q", "l_extendedprice")))  # noqa: E741
    lines = l.where("twin = 1").groupBy("plan_id").agg(F.collect_list(F.struct("n", "d")).alias("lines"))
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    u = l.where("twin = 1 OR q < 10").join(lines, "plan_id", "left")
    before = F.filter("lines", lambda b: (b["n"] < F.col("n")) & (b["d"] <= F.col("d")))
    deps = F.array_sort(F.array_distinct(F.transform(before, lambda b: name(b["n"]))))
    q, none = F.col("q"), F.array().cast("array<string>")
    more = F.when(q == 5, F.array(name(F.col("n")))).when(q == 6, F.array(F.lit("t99"))).when(q == 7, F.array(F.lit(" "))).when((q == 8) & (F.col("n") == 1), F.array(F.lit("t2"))).otherwise(none)
    return u.select("plan_id", "n", F.when(q == 3, "").otherwise(name(F.col("n"))).alias("task"), "q", "p", F.when(q == 4, " ").otherwise(F.concat(F.lit("part "), F.col("p").cast("string"))).alias("description"), F.when(F.col("p") % 50 == 7, "poem").otherwise("research").alias("task_type"), (q % 11).cast("int").alias("priority"), F.concat(F.coalesce(deps, none), more).alias("deps"))


@query("g5_plan_problems", f"""WITH RECURSIVE {TASKS}, k AS (SELECT plan_id, count(*) AS n, count(DISTINCT task) AS ids, list(DISTINCT task) AS known FROM tasks GROUP BY plan_id),
v AS (SELECT plan_id, min(CASE WHEN k.n > 5 THEN 0 WHEN trim(task) = '' THEN 1 WHEN ids < k.n THEN 2 WHEN trim(description) = '' THEN 3 WHEN task_type NOT IN ('research', 'verify', 'code', 'analysis', 'comparison') THEN 4 WHEN priority NOT BETWEEN 1 AND 10 THEN 5 WHEN len(list_filter(deps, lambda x: trim(x) = '')) > 0 THEN 6 WHEN len(list_filter(deps, lambda x: NOT list_contains(known, x))) > 0 THEN 7 WHEN list_contains(deps, task) THEN 8 END) AS level FROM tasks JOIN k USING (plan_id) GROUP BY plan_id),
e AS (SELECT plan_id, task, unnest(deps) AS dep FROM tasks SEMI JOIN (SELECT plan_id FROM v WHERE level IS NULL) s USING (plan_id)),
r AS (SELECT plan_id, task, dep FROM e UNION SELECT e.plan_id, e.task, r.dep FROM r JOIN e ON e.plan_id = r.plan_id AND e.dep = r.task)
SELECT plan_id, CASE WHEN level IS NOT NULL THEN ['too_many', 'empty_id', 'duplicate_id', 'empty_description', 'task_type', 'priority', 'empty_dependency', 'unknown_dependency', 'self_dependency'][level + 1] WHEN plan_id IN (SELECT plan_id FROM r WHERE task = dep) THEN 'cycle' END AS problem FROM v""")
def plan_problems(spark, d):
    return P.plan_problems(_tasks(spark, d).withColumnRenamed("task", "task_id"))


SOUND = f"""{TASKS}, t AS (SELECT plan_id, task, any_value(n) AS n, min(q) AS q, min(p) AS p, list_distinct(flatten(list(deps))) AS deps FROM tasks WHERE task <> '' AND q NOT IN (5, 6, 7, 8) GROUP BY plan_id, task)"""


def _sound(spark, d):
    t = _tasks(spark, d).where("task <> '' AND q NOT IN (5, 6, 7, 8)")
    return t.groupBy("plan_id", "task").agg(F.min("n").alias("n"), F.min("q").alias("q"), F.min("p").alias("p"), F.array_distinct(F.flatten(F.collect_list("deps"))).alias("deps"))


@query("g7_pruned_plans", f"""WITH RECURSIVE {SOUND}, e AS (SELECT plan_id, task, unnest(deps) AS dep FROM t), c AS (SELECT plan_id, count(*) AS m FROM t GROUP BY plan_id),
r AS (SELECT plan_id, task FROM t JOIN c USING (plan_id) WHERE p % 9 = 0 AND m > 1 UNION SELECT e.plan_id, e.task FROM r JOIN e ON e.plan_id = r.plan_id AND e.dep = r.task)
SELECT plan_id, task FROM t WHERE (plan_id, task) NOT IN (FROM r) OR plan_id NOT IN (SELECT plan_id FROM t WHERE (plan_id, task) NOT IN (FROM r))""")
def pruned_plans(spark, d):
    """Tasks on every ninth part only compose the end."""
    return P.pruned(_sound(spark, d), F.col("p") % 9 == 0).select("plan_id", "task")


@query("g12_task_depths", f"""WITH RECURSIVE {SOUND}, e AS (SELECT a.plan_id, a.task, x.dep FROM (SELECT plan_id, task, unnest(deps) AS dep FROM t) x JOIN t a USING (plan_id, task) WHERE (x.plan_id, x.dep) IN (SELECT plan_id, task FROM t)),
w AS (SELECT plan_id, task, 0 AS depth FROM t UNION SELECT e.plan_id, e.task, w.depth + 1 FROM w JOIN e ON e.plan_id = w.plan_id AND e.dep = w.task),
x AS (SELECT plan_id, task, max(depth) AS depth FROM w GROUP BY ALL)
SELECT plan_id, task, depth, row_number() OVER (PARTITION BY plan_id, depth ORDER BY task) AS place, (SELECT count(*) FROM e WHERE e.plan_id = x.plan_id AND e.task = x.task) AS n_deps FROM x""")
def task_depths(spark, d):
    t = _sound(spark, d)
    known = t.groupBy("plan_id").agg(F.collect_set("task").alias("known"))
    t = t.join(known, "plan_id").withColumn("deps", F.array_intersect("deps", "known"))
    w = P.waves_by_plan(t).withColumnRenamed("wave", "depth")
    place = F.row_number().over(Window.partitionBy("plan_id", "depth").orderBy("task"))
    return w.select("plan_id", "task", "depth", place.cast("long").alias("place"), F.size("deps").cast("long").alias("n_deps"))


@query("j13_dependency_context", f"""WITH {SOUND}, o AS (SELECT *, CASE WHEN q % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN q % 7 = 0 THEN '' ELSE 'found ' || q END AS output FROM t),
w AS (SELECT plan_id, task, unnest(deps) AS dep, generate_subscripts(deps, 1) AS pos FROM (SELECT plan_id, task, list_sort(deps) AS deps FROM o))
SELECT o.plan_id, o.task, coalesce(string_agg('## ' || b.task || ': ' || b.p || chr(10) || chr(10) || b.output, chr(10) || chr(10) ORDER BY pos), '') AS context FROM o LEFT JOIN w USING (plan_id, task) LEFT JOIN (SELECT * FROM o WHERE status = 'completed' AND output <> '') b ON b.plan_id = w.plan_id AND b.task = w.dep GROUP BY ALL""")
def dependency_context(spark, d):
    q = F.col("q").cast("int")
    t = _sound(spark, d).select("plan_id", "task", F.array_sort("deps").alias("deps"), F.col("p").cast("string").alias("description"), F.when(q % 3 == 0, "failed").otherwise("completed").alias("status"), F.when(q % 7 == 0, "").otherwise(F.concat(F.lit("found "), F.col("q").cast("string"))).alias("output"))
    return P.dependency_context(t)


@query("a36_failure_text", """WITH o AS (SELECT l_orderkey AS plan_id, l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS task, CASE WHEN l_returnflag <> 'N' THEN repeat(l_returnflag || l_linestatus || ' ', 120) END AS error FROM lineitem)
SELECT plan_id, count(error) AS n_failed, count(error) = count(*) AS all_failed, coalesce(string_agg('- ' || task || ': ' || substr(error, 1, 300), chr(10) ORDER BY task) FILTER (error IS NOT NULL), '') AS reasons FROM o GROUP BY plan_id""")
def failure_text(spark, d):
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") * 100 + nth).alias("task"), F.when(F.col("l_returnflag") != "N", F.repeat(F.concat("l_returnflag", "l_linestatus", F.lit(" ")), F.lit(120))).alias("error"))
    return P.failure_text(o, "plan_id")
