"""Queries on budgets, sections, admission, bands and coercions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import rules as R
from lorebase.plans.registry import query, table

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query("w15_report_sections", f"WITH {LINES}, s AS (SELECT *, sum((length(line) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM l) SELECT doc_id, section, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM s GROUP BY ALL")
def report_sections(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    s = R.sections(lines, "doc_id", F.length("line") < 40)
    return s.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query("w10_memory_eviction", "WITH e AS (SELECT event_id, user_id, length(props) AS n, round(value - epoch_us(TIMESTAMP '2024-01-31' - ts) / 3600000000, 9) AS score FROM events) SELECT event_id, total - before <= 500 AS kept FROM (SELECT event_id, sum(n) OVER (PARTITION BY user_id) AS total, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY score, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)")
def memory_eviction(spark, d):
    """An entry's score is its importance less its age in hours."""
    hours = F.expr("timestampdiff(MICROSECOND, CAST(ts AS TIMESTAMP_NTZ), TIMESTAMP_NTZ'2024-01-31 00:00:00')") / 3600000000
    e = table(spark, d, "events").withColumn("chars", F.length("props")).withColumn("score", F.round(F.col("value") - hours, 9))
    return R.evict(e, "user_id", "score", "chars", "event_id", 500).select("event_id", "kept")


@query("w11_context_string", "SELECT conv_id, turn, substr(text, 1, greatest(0, 800 - before)::INT) || CASE WHEN before < 800 AND before + length(text) > 800 THEN '...' ELSE '' END AS taken FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, length(text) DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)")
def context_string(spark, d):
    """Kinds in order, within a kind by falling importance; the entry that is cut ends with dots."""
    first = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return R.cut_to_budget(table(spark, d, "conversations"), "conv_id", [first, F.desc(F.length("text")), F.col("turn")], "text", 800, "...").select("conv_id", "turn", "taken")


@query("p40_tool_admission", "SELECT event_id, f AND s <= 12 AS admitted FROM (SELECT event_id, f, sum(f::INT) OVER (PARTITION BY user_id ORDER BY day, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) <= 4 AS f FROM events))")
def tool_admission(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return R.admit(e, "user_id", "day", ["event_id"], 4, 12).select("event_id", "admitted")


@query("j15_near_duplicate_spans", "SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 600000000 AND (b.ts > a.ts OR b.event_id > a.event_id)")
def near_duplicate_spans(spark, d):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = table(spark, d, "events").select(F.struct("user_id", "event_type").alias("key"), F.col("event_id").alias("id"), micros.alias("at"))
    return R.band_pairs(e, "key", "at", 600_000_000).select(F.col("k.user_id").alias("user_id"), "a", "b")


@query("a26_plan_completion", "SELECT l_orderkey AS plan_id, count(*) AS n_tasks, count(*) FILTER (l_linestatus = 'F') AS n_done, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY 1")
def plan_completion(spark, d):
    done = F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(done).alias("n_done"), F.bool_and(done).alias("complete"))


@query("t11_ready_tasks", "WITH d AS (SELECT l_orderkey AS plan_id, l_linenumber AS task, bool_or(l_linestatus = 'F') AS done, max(l_quantity % 10) AS priority FROM lineitem GROUP BY ALL) SELECT a.plan_id, a.task, row_number() OVER (PARTITION BY a.plan_id ORDER BY a.priority DESC, a.task) AS position FROM d a LEFT JOIN d b ON a.plan_id = b.plan_id AND b.task = a.task - 1 WHERE NOT a.done AND coalesce(b.done, TRUE)")
def ready_tasks(spark, d):
    """Open tasks whose dependency is done, by priority and then id."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("task")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("done"), F.max(F.col("l_quantity") % 10).alias("priority"))
    b = t.select("plan_id", (F.col("task") + 1).alias("task"), F.col("done").alias("dep_done"))
    w = Window.partitionBy("plan_id").orderBy(F.desc("priority"), "task")
    return t.join(b, ["plan_id", "task"], "left").where(~F.col("done") & F.coalesce("dep_done", F.lit(True))).select("plan_id", "task", F.row_number().over(w).cast("long").alias("position"))


@query("x39_display_costs", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 'no price' WHEN 1 THEN 'no usage' WHEN 2 THEN 'free' ELSE '$' || CASE WHEN c < 0.01 THEN printf('%.6f', c) ELSE printf('%.3f', c) END || CASE WHEN l_partkey % 5 = 3 THEN '+' ELSE '' END END AS cost, format('{:,}', (l_quantity * 1000)::BIGINT) AS tokens FROM (SELECT *, l_suppkey / 7000 AS c FROM lineitem)")
def display_costs(spark, d):
    k = F.col("l_partkey") % 5
    status = F.when(k == 0, "pricing_unconfigured").when(k == 1, "usage_unavailable").when(k == 2, "not_applicable").when(k == 3, "partial").otherwise("estimated")
    names = {"pricing_unconfigured": "no price", "usage_unavailable": "no usage", "not_applicable": "free"}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.show_cost(F.col("l_suppkey") / 7000, status, names).alias("cost"), R.show_count((F.col("l_quantity") * 1000).cast("long")).alias("tokens"))


@query("x39_display_durations", "SELECT event_id, CASE WHEN ms < 1000 THEN floor(ms)::BIGINT || 'ms' WHEN floor(ms / 1000) < 60 THEN floor(ms / 1000)::BIGINT || 's' ELSE floor(floor(ms / 1000) / 60)::BIGINT || 'm ' || (floor(ms / 1000)::BIGINT % 60) || 's' END AS shown FROM (SELECT event_id, value * (event_id % 1000) AS ms FROM events)")
def display_durations(spark, d):
    return table(spark, d, "events").select("event_id", R.show_duration(F.col("value") * (F.col("event_id") % 1000)).alias("shown"))


@query("x30_weight_coercion", "SELECT event_id, round(CASE WHEN w IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, w)) END, 6) AS weight FROM (SELECT event_id, try_cast(CASE event_id % 4 WHEN 0 THEN (value / 100)::VARCHAR WHEN 1 THEN 'none' WHEN 2 THEN '-0.5' ELSE '0.25' END AS DOUBLE) AS w FROM events)")
def weight_coercion(spark, d):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, (F.col("value") / 100).cast("string")).when(k == 1, "none").when(k == 2, "-0.5").otherwise("0.25")
    return table(spark, d, "events").select("event_id", F.round(R.coerce_weight(raw), 6).alias("weight"))


@query("k34_safe_names", r"SELECT page_id, CASE WHEN n = '' THEN 'file' ELSE substr(n, 1, 80) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^\.+', '') AS n FROM pages)")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", R.safe_name(F.col("url")).alias("name"))


@query("j16_adjacent_similarity", """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM u)
SELECT vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)) + 1e-8::DOUBLE), 5) AS similarity FROM p WHERE w IS NOT NULL""")
def adjacent_similarity(spark, d):
    e = table(spark, d, "embeddings").withColumn("w", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("w IS NOT NULL")
    return e.select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("w")), 5).alias("similarity"))


@query("u4_eligible_minus_selected", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def eligible_minus_selected(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti").distinct()


@query("p16_page_needs_ocr", r"SELECT doc_id, length(s)::BIGINT AS solid, length(s) < 80 OR length(regexp_replace(s, '[\p{C}]', '', 'g')) / length(s) < 0.85 AS needs_ocr FROM (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 7 = 0 THEN replace(text, 'e', chr(1)) || repeat(chr(2), 99) ELSE text END, '\s', '', 'g') AS s FROM documents)")
def page_needs_ocr(spark, d):
    """Under 80 solid characters, or under 85 % of them printable; some texts are made unprintable."""
    bad = F.concat(F.replace("text", F.lit("e"), F.lit("\x01")), F.lit("\x02" * 99))
    text = F.when(F.col("doc_id") % 7 == 0, bad).otherwise(F.col("text"))
    solid, needs = R.needs_ocr(text, 80, 0.85)
    return table(spark, d, "documents").select("doc_id", solid.cast("long").alias("solid"), needs.alias("needs_ocr"))


@query("w18_even_sampling", """WITH t AS (SELECT doc_id, text, length(text) AS n, 200 AS size FROM documents), s AS (SELECT doc_id, n, string_agg(substr(text, round_even(i * greatest(0, n - size) / 2.0::DOUBLE, 0)::INT + 1, size), chr(10) || chr(10) || '[...]' || chr(10) || chr(10) ORDER BY i) AS x FROM t, range(0, 3) r(i) GROUP BY ALL)
SELECT s.doc_id, md5(CASE WHEN s.n <= 618 THEN text ELSE substr(x, 1, 618) END) AS digest FROM s JOIN t USING (doc_id)""")
def even_sampling(spark, d):
    """Whole up to the budget; beyond it, segments at even distances that fill the budget."""
    return table(spark, d, "documents").select("doc_id", F.md5(R.sampled(F.col("text"), 618)).alias("digest"))


@query("a28_refinement_accepted", """WITH s AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, [l_quantity % 10, l_partkey % 10, l_suppkey % 10, l_extendedprice % 10, l_linenumber] AS v FROM lineitem),
p AS (SELECT *, lag(v) OVER (PARTITION BY l_orderkey ORDER BY n) AS u FROM s)
SELECT l_orderkey, n, round(list_sum(v) - list_sum(u), 6) >= -0.5 AND len(list_filter([1, 2, 3, 4, 5], lambda k: round(u[k] - v[k], 6) > 6)) = 0 AS accepted FROM p WHERE u IS NOT NULL""")
def refinement_accepted(spark, d):
    """Five dimensions of a line against the one before: the sum hardly falls and none falls by over 6."""
    dims = F.array(F.col("l_quantity") % 10, (F.col("l_partkey") % 10).cast("double"), (F.col("l_suppkey") % 10).cast("double"), F.col("l_extendedprice") % 10, F.col("l_linenumber").cast("double"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    p = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("n"), dims.alias("v"), F.lag(dims).over(w).alias("u")).where("u IS NOT NULL")
    return p.select("l_orderkey", "n", R.refinement_accepted(F.col("u"), F.col("v"), 0.5, 6.0).alias("accepted"))
