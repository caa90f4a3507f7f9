"""Entity graphs as they are kept and queried: relations by key, active views, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.graph import components


def merged_relations(contributions: DataFrame) -> DataFrame:
    """(source, target, type, weight, n_docs): relations by key, the strongest weight of their documents.

    contributions: (doc_id, source, target, type, weight); a document counts with its last
    (largest) weight once; relations without an end go.
    """
    given = contributions.where((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    by_doc = given.groupBy("source", "target", "type", "doc_id").agg(F.max("weight").alias("weight"))
    return by_doc.groupBy("source", "target", "type").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n_docs"))


def with_known_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose both ends are entities, with their names."""
    name = lambda end: entities.select(F.col("entity_id").alias(end), F.col("name").alias(end + "_name"))
    return relations.join(name("source"), "source").join(name("target"), "target")


def active_entities(contributions: DataFrame, excluded: DataFrame) -> DataFrame:
    """(entity_id, name, type, n_docs) of the documents that are not excluded.

    Each field is the first that isn't empty, in the order of documents.
    """
    left = contributions.join(excluded.select("doc_id"), "doc_id", "left_anti")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("doc_id"))), F.lit(""))
    return left.groupBy("entity_id").agg(first("name").alias("name"), first("type").alias("type"), F.count_distinct("doc_id").alias("n_docs"))


def communities(relations: DataFrame, least: int = 2, most: int = 500) -> DataFrame:
    """(entity_id, community): components of ``least`` entities or more, numbered from 0 by their smallest entity.

    At most the first ``most`` communities stay.
    """
    c = components(relations.select("source", "target"))
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    first = sizes.orderBy("component").limit(most)
    w = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("component"))
    return c.join(first.select("component", (w - 1).cast("long").alias("community")), "component").select(F.col("node").alias("entity_id"), "community")


def community_fingerprints(members: DataFrame) -> DataFrame:
    """(community, fingerprint, n): SHA-256 over members' lines (id, name, type, description by tabs) in order of id.

    A community's members are digested in blocks of a thousand ids first, so that a large one
    is never one row of text.
    """
    line = F.concat_ws("\t", F.col("entity_id").cast("string"), "name", "type", "description")
    blocks = members.groupBy("community", F.floor(F.col("entity_id") / 1000).alias("block")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("m"))
    return blocks.groupBy("community").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"), F.sum("m").alias("n"))


def default_summaries(members: DataFrame, names: int = 10) -> DataFrame:
    """(community, summary): the names of the first ten members in order of id."""
    r = members.where("name <> ''").withColumn("__r", F.row_number().over(Window.partitionBy("community").orderBy("entity_id"))).where(F.col("__r") <= names)
    x = F.array_sort(F.collect_list(F.struct("entity_id", "name")))
    return r.groupBy("community").agg(F.concat(F.lit("Entities: "), F.array_join(F.transform(x, lambda e: e["name"]), ", ")).alias("summary"))


def cached_summaries(fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """(community, summary, cached): the cached summary of the same fingerprint, else the fresh one.

    fresh: (community, fingerprint, summary), cache: (fingerprint, summary), one row a fingerprint.
    """
    c = cache.select("fingerprint", F.col("summary").alias("__cached"))
    return fresh.join(c, "fingerprint", "left").select("community", F.coalesce("__cached", "summary").alias("summary"), F.col("__cached").isNotNull().alias("cached"))


def summary_node_id(level: Column, cluster: Column, children: Column, summary: Column) -> Column:
    """A summary's id from its level, its cluster's number, its children's ids and its text."""
    head = lambda c: F.substring(F.md5(c), 1, 8)
    return F.concat(F.lit("raptor_l"), level.cast("string"), F.lit("_c"), cluster.cast("string"), F.lit("_"), head(F.array_join(children, "|")), F.lit("_"), head(summary))
