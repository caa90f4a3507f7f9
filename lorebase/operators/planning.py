"""Plans of tasks: validation, pruning, depth, context of dependencies, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.graph import _saved, plan_waves

# Task types of a plan.
TASK_TYPES = ["research", "verify", "code", "analysis", "comparison"]


def _waves(rows: Column) -> Column:
    """array(task, deps, wave) of an array(task, deps) with one row a task: :func:`plan_waves` inside one row.

    Tasks that are in a deadlock have a null wave.
    """
    told = lambda x, wave: F.struct(x["task"].alias("task"), x["deps"].alias("deps"), wave.cast("int").alias("wave"))
    none = F.slice(rows, 1, 0)
    start = F.struct(rows.alias("left"), F.transform(none, lambda x: x["task"]).alias("done"), F.transform(none, lambda x: told(x, F.lit(0))).alias("waves"))

    def step(state: Column, wave: Column) -> Column:
        waits = lambda x: F.size(F.array_except(x["deps"], state["done"])) > 0
        ready = F.filter(state["left"], lambda x: ~waits(x))
        return F.struct(
            F.filter(state["left"], waits).alias("left"),
            F.concat(state["done"], F.transform(ready, lambda x: x["task"])).alias("done"),
            F.concat(state["waves"], F.transform(ready, lambda x: told(x, wave))).alias("waves"),
        )

    steps = F.slice(F.sequence(F.lit(0), F.size(rows)), F.lit(1), F.size(rows))
    return F.aggregate(steps, start, step, lambda state: F.concat(state["waves"], F.transform(state["left"], lambda x: told(x, F.lit(None)))))


def waves_by_plan(tasks: DataFrame, crowd: int = 64) -> DataFrame:
    """(plan_id, task, deps, wave) of (plan_id, task, deps): :func:`plan_waves` of each plan, whose tasks depend on its own only.

    One row a task, deps not null.  Plans of up to ``crowd`` tasks are one row each, in which
    all waves are found without a join; larger ones take one join a wave.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("plan_id"))
    t = tasks.select("plan_id", "task", "deps").withColumn("__n", n)
    few = F.collect_list(F.when(F.col("__n") <= crowd, F.struct("task", "deps")))
    plans = _saved(t.groupBy("plan_id").agg(F.max("__n").alias("n"), few.alias("rows")))
    small = plans.where(F.col("n") <= crowd).select("plan_id", F.explode(_waves(F.col("rows"))).alias("x")).select("plan_id", "x.*")
    large = plans.where(F.col("n") > crowd).select("plan_id")
    if large.isEmpty():
        return small
    rows = _saved(t.drop("__n").join(large, "plan_id", "left_semi"))
    key = lambda task: F.struct(F.col("plan_id").alias("plan_id"), task.alias("task"))
    waves = plan_waves(rows.select(key(F.col("task")).alias("task"), F.transform("deps", key).alias("deps"))).select("task.*", "wave")
    return small.unionByName(rows.join(waves, ["plan_id", "task"]))


def plan_problems(tasks: DataFrame, most: int = 5) -> DataFrame:
    """(plan_id, problem): the first rule that a plan breaks, null for a valid one.

    tasks: (plan_id, task_id, description, task_type, priority, deps).  In order: too_many,
    empty_id, duplicate_id, empty_description, task_type, priority (1 to 10), empty_dependency,
    unknown_dependency, self_dependency, cycle.  A plan that breaks no rule has at most ``most`` tasks,
    so its cycles are looked for in one row.
    """
    of = tasks.groupBy("plan_id").agg(F.count(F.lit(1)).alias("__n"), F.count_distinct("task_id").alias("__ids"), F.collect_set("task_id").alias("__known"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    t = tasks.join(of, "plan_id")
    rules = [
        ("too_many", F.col("__n") > most),
        ("empty_id", blank(F.col("task_id"))),
        ("duplicate_id", F.col("__ids") < F.col("__n")),
        ("empty_description", blank(F.col("description"))),
        ("task_type", ~F.col("task_type").isin(TASK_TYPES)),
        ("priority", ~F.col("priority").between(1, 10)),
        ("empty_dependency", F.exists("deps", blank)),
        ("unknown_dependency", F.size(F.array_except("deps", "__known")) > 0),
        ("self_dependency", F.array_contains("deps", F.col("task_id"))),
    ]
    level = F.coalesce(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(k)) for k, (_, rule) in enumerate(rules)])
    rows = F.collect_list(F.when(F.col("__n") <= most, F.struct(F.col("task_id").alias("task"), "deps")))
    first = t.groupBy("plan_id").agg(F.min(level).alias("level"), rows.alias("rows"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in rules]), (F.col("level") + 1).cast("int"))
    return first.select("plan_id", F.when(F.col("level").isNotNull(), name).when(F.exists(_waves(F.col("rows")), lambda x: x["wave"].isNull()), "cycle").alias("problem"))


def descendants(edges: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """(by, task): the tasks in ``start`` and all that depend on them, by one join a level.

    edges: (by, task, dep).
    """
    key = [*by, "task"]
    reached = front = _saved(start.select(*key).distinct())
    while not front.isEmpty():
        after = edges.join(front.withColumnRenamed("task", "dep"), [*by, "dep"]).select(*key).distinct()
        front = _saved(after.join(reached, key, "left_anti"))
        reached = _saved(reached.unionByName(front))
    return reached


def pruned(tasks: DataFrame, final: Column) -> DataFrame:
    """Tasks without those that only compose the end (``final``) and all that depend on these.

    A plan of one task, or of which nothing would be left, stays whole.  tasks: (plan_id,
    task, deps, ...).
    """
    n = Window.partitionBy("plan_id")
    t = tasks.withColumn("__n", F.count(F.lit(1)).over(n))
    edges = _saved(tasks.select("plan_id", "task", F.explode("deps").alias("dep")))
    gone = descendants(edges, t.where(final & (F.col("__n") > 1)), ["plan_id"]).withColumn("__gone", F.lit(True))
    t = t.join(gone, ["plan_id", "task"], "left").withColumn("__left", F.count_if(F.col("__gone").isNull()).over(n))
    return t.where(F.col("__gone").isNull() | (F.col("__left") == 0)).drop("__n", "__gone", "__left")


def dependency_context(tasks: DataFrame) -> DataFrame:
    """(plan_id, task, context): the results of a task's completed dependencies, in its order.

    tasks: (plan_id, task, description, deps, status, output).
    """
    want = tasks.select("plan_id", "task", F.posexplode("deps").alias("at", "dep"))
    have = tasks.where("status = 'completed' AND output <> ''").select("plan_id", F.col("task").alias("dep"), F.concat(F.lit("## "), F.col("task").cast("string"), F.lit(": "), F.col("description"), F.lit("\n\n"), F.col("output")).alias("section"))
    got = want.join(have, ["plan_id", "dep"]).groupBy("plan_id", "task").agg(F.array_sort(F.collect_list(F.struct("at", "section"))).alias("s"))
    j = tasks.select("plan_id", "task").join(got, ["plan_id", "task"], "left")
    return j.select("plan_id", "task", F.coalesce(F.array_join(F.transform("s", lambda x: x["section"]), "\n\n"), F.lit("")).alias("context"))


def failure_text(outputs: DataFrame, by: str, chars: int = 300) -> DataFrame:
    """(by, n_failed, all_failed, reasons): failed subtasks with the first characters of their reasons."""
    bad = F.col("error").isNotNull()
    line = F.concat(F.lit("- "), F.col("task").cast("string"), F.lit(": "), F.substring("error", 1, chars))
    x = F.array_sort(F.collect_list(F.when(bad, F.struct("task", line.alias("line")))))
    return outputs.groupBy(by).agg(F.count_if(bad).alias("n_failed"), (F.count_if(bad) == F.count(F.lit(1))).alias("all_failed"), F.array_join(F.transform(x, lambda i: i["line"]), "\n").alias("reasons"))
