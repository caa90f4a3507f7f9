"""Keyed tables that change: catalogs, messages, conversations, summaries, snapshots, memories, jobs.

Every function returns the table as it is after the change, as a DataFrame to be written as a
new version; the change itself is one join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(old: DataFrame, changes: DataFrame, key: list[str], replace: dict[str, Column], insert: dict[str, Column], grows: bool = True) -> DataFrame:
    """Rows of ``old`` with columns replaced where ``changes`` has their key, and, if it ``grows``, new keys added.

    ``replace`` and ``insert`` give values by column; they may use the old columns and those
    of ``changes``, whose names begin with new_.  Columns without a rule stay, or are null.
    A table that doesn't grow is hashed by key, and changes stream past it, as their texts would
    fill a sort.
    """
    c = changes.select(*key, *[F.col(k).alias("new_" + k) for k in changes.columns if k not in key], F.lit(True).alias("__new"))
    known = old.withColumn("__old", F.lit(True))
    j = known.join(c, key, "full") if grows else known.hint("shuffle_hash").join(c, key, "left")
    has = F.col("__new").isNotNull()
    value = lambda k: F.when(F.col("__old").isNull(), insert[k] if k in insert else F.lit(None)).when(has, replace[k] if k in replace else F.col(k)).otherwise(F.col(k))
    return j.select(*key, *[value(k).alias(k) for k in old.columns if k not in key])


def upsert_document(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalog rows replaced by key; metadata stays where the new row has none."""
    given = ["filename", "chunk_count", "status", "error"]
    take = {k: F.col("new_" + k) for k in given}
    return changed(old, new, ["doc_id"], take | {"metadata": F.coalesce("new_metadata", "metadata")}, take | {"metadata": F.coalesce("new_metadata", F.lit("{}")), "enabled": F.lit(True)})


def bulk_upsert_indexed(old: DataFrame, new: DataFrame) -> DataFrame:
    """New documents are added as indexed; known ones change only if they were not indexed."""
    stale = F.col("status") != "indexed"
    keep = lambda k, v: F.when(stale, v).otherwise(F.col(k))
    replace = {"filename": keep("filename", F.col("new_filename")), "chunk_count": keep("chunk_count", F.col("new_chunk_count")), "status": F.lit("indexed"), "error": F.when(~stale, F.col("error"))}
    return changed(old, new, ["doc_id"], replace, {"filename": F.col("new_filename"), "chunk_count": F.col("new_chunk_count"), "status": F.lit("indexed"), "enabled": F.lit(True), "metadata": F.lit("{}")})


def set_enabled(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Enabled as wanted (doc_id, enabled) where a document is indexed."""
    return changed(catalog, wanted.join(catalog.select("doc_id"), "doc_id", "left_semi"), ["doc_id"], {"enabled": F.when(F.col("status") == "indexed", F.col("new_enabled")).otherwise(F.col("enabled"))}, {})


def without(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in ``gone``."""
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def update_conversations(old: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations after updates that expect a version, and the updates that were refused.

    wanted: (conv_id, expected, title, status).  A null expectation always holds.  A title is
    trimmed and cut to 200 characters, and a blank one changes nothing; the version rises by
    one.  Refused: missing or deleted ones (not_found) and other versions (version_conflict).
    """
    j = wanted.join(old.select("conv_id", "version", "deleted"), "conv_id", "left")
    bad = F.when(F.col("version").isNull() | F.col("deleted"), "not_found").when(F.col("expected") != F.col("version"), "version_conflict")
    j = j.withColumn("problem", bad)
    title = F.substring(F.trim("new_title"), 1, 200)
    rules = {"title": F.when(title != "", title).otherwise(F.col("title")), "status": F.coalesce("new_status", "status"), "version": F.col("version") + 1}
    good = j.where("problem IS NULL").select("conv_id", "title", "status")
    return changed(old, good, ["conv_id"], rules, {}), j.where("problem IS NOT NULL").select("conv_id", "problem")


def delete_conversations(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Live conversations in ``gone`` are marked deleted and rise by one version."""
    live = ~F.col("deleted")
    rules = {"status": F.when(live, "deleted").otherwise(F.col("status")), "version": F.when(live, F.col("version") + 1).otherwise(F.col("version")), "deleted": F.lit(True)}
    return changed(old, gone.join(old.select("conv_id"), "conv_id", "left_semi"), ["conv_id"], rules, {})


def replace_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Active summaries of a conversation with a new one are superseded; the new one is active, version 1."""
    has = new.select("conv_id").distinct().withColumn("__new", F.lit(True))
    status = F.when(F.col("__new").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    kept = old.join(has, "conv_id", "left").withColumn("status", status).drop("__new")
    return kept.unionByName(new.withColumn("status", F.lit("active")).withColumn("version", F.lit(1).cast(old.schema["version"].dataType)).select(*old.columns))


def add_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks are added, one for each key."""
    w = Window.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key] or key)
    fresh = new.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    same = [F.col("o." + k).eqNullSafe(F.col("n." + k)) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return old.unionByName(fresh.alias("n").join(old.select(*key).distinct().alias("o"), on, "left_anti").select(*old.columns))


def add_memories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Memories by (user, category, trimmed content): added where no active one says the same.

    Contents are cut to 20,000 characters and confidence is held between 0 and 1.
    """
    text = F.trim("content")
    n = new.withColumn("content", text).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).withColumn("status", F.lit("active"))
    key = ["user_id", "category", "content"]
    first = Window.partitionBy(*key).orderBy("memory_id")
    n = n.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    known = old.where("status = 'active'").select(*key).distinct()
    return old.unionByName(n.join(known, key, "left_anti").withColumn("content", F.substring("content", 1, 20000)).select(*old.columns))


def create_snapshots(old: DataFrame, bundles: DataFrame) -> DataFrame:
    """Snapshots of runs that have none yet: (run_id, fingerprint, items), items ranked from 1."""
    return add_if_absent(old, bundles.select(*old.columns), ["run_id"])


def snapshot_items(snapshots: DataFrame) -> DataFrame:
    """(run_id, rank, item): the items of each snapshot in order; a snapshot without items has one null row."""
    return snapshots.select("run_id", F.posexplode_outer("items").alias("__at", "item")).select("run_id", (F.col("__at") + 1).alias("rank"), "item")


def snapshots_with_items(snapshots: DataFrame, items: DataFrame) -> DataFrame:
    """(run_id, items, n): each snapshot with its items joined in the order of their rank."""
    g = items.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("x"))
    j = snapshots.select("run_id").join(g, "run_id", "left")
    x = F.coalesce("x", F.array().cast(g.schema["x"].dataType))
    return j.select("run_id", F.array_join(F.transform(x, lambda i: i["item"]), ",").alias("items"), F.size(x).cast("long").alias("n"))


def unexpired(table: DataFrame, created: str, now: Column, days: int) -> DataFrame:
    """Rows created at most ``days`` (1 at least) before ``now``."""
    return table.where(F.col(created) >= now - F.make_dt_interval(F.lit(max(1, days))))


def update_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after updates: progress held in 0 to 100, errors cut at 2,000, timings rounded to 3.

    A null leaves what was; cancelling marks jobs that are not at an end.
    """
    ended = F.col("status").isin("completed", "failed", "cancelled")
    rules = {
        "progress": F.when(F.col("new_progress").isNull(), F.col("progress")).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("new_progress")))),
        "error": F.coalesce("new_error", "error"),
        "seconds": F.coalesce(F.round("new_seconds", 3), F.col("seconds")),
        "status": F.coalesce("new_status", "status"),
        "cancel": F.col("cancel") | (F.coalesce("new_cancel", F.lit(False)) & ~ended),
    }
    return changed(jobs, updates.withColumn("error", F.substring("error", 1, 2000)), ["job_id"], rules, {}, grows=False)


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that were queued or running when the service stopped, as queued."""
    return jobs.where(F.col("status").isin("queued", "running")).withColumn("status", F.lit("queued"))


def create_artifacts(rows: DataFrame) -> DataFrame:
    """Artifacts as they are stored: title cut at 300 or else the type, content at 100,000, sources at 100."""
    title = F.substring(F.trim("title"), 1, 300)
    return rows.withColumn("title", F.when(title == "", F.col("artifact_type")).otherwise(title)).withColumn("content", F.substring(F.trim("content"), 1, 100_000)).withColumn("source_ids", F.slice("source_ids", 1, 100))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys in ``gone``."""
    return {name: without(t, gone, [key]) for name, t in tables.items()}
