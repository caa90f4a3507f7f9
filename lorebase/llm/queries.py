"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import ball_kmeans, chat_format, conversation_repair, embedding_dedup, exact_dedup, mixing, paragraphs, pieces, sharding, simhash, substrings, toxicity, turn_sql, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.dedup_paragraphs(_table(spark, sf_dir, "documents"), least=11, joined=True)


def op2_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(_table(spark, sf_dir, "embeddings"))


def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_documents(docs, 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_ids(_table(spark, sf_dir, "documents"))


def op7_piece_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op8_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_ids(_table(spark, sf_dir, "documents"))


def op10_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_format.laid_out(chat_format.control_case(_table(spark, sf_dir, "conversations")))
    return chat_format.read_back(chat_format.format_records(records))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ball_kmeans.clusters(_table(spark, sf_dir, "embeddings"))
    return out.drop("compared")


SQL_OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
classed AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM sized),
by_class AS (SELECT source, class, sum(size)::BIGINT AS words FROM classed GROUP BY source, class),
sources AS (SELECT source, sum(words)::BIGINT AS source_size FROM by_class GROUP BY source),
weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS lim,
    ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS w FROM sources),
filled AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER upto, 0.0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER upto, 0.0) AS weight
  FROM weighed WINDOW upto AS (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, rest * w >= lim * weight AS is_full FROM filled),
lvl AS (SELECT rest AS lrest, weight AS lweight FROM marked WHERE NOT is_full ORDER BY lim / w, source IS NULL, source LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN lim ELSE (SELECT lrest FROM lvl) * w / (SELECT lweight FROM lvl) END AS target FROM marked),
massed AS (
  SELECT b.source, b.class, b.words, t.source_size, t.target, pow(2.0::DOUBLE, -0.125::DOUBLE * b.class) AS f
  FROM by_class b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
needs AS (
  SELECT *, target - 3.0::DOUBLE * coalesce(sum(words) OVER upto, 0) AS need,
    sum(f * words) OVER (PARTITION BY source) - coalesce(sum(f * words) OVER upto, 0.0) AS mass
  FROM massed WINDOW upto AS (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
limited AS (SELECT *, need * f >= 3.0 * mass AS is_full FROM needs),
scales AS (SELECT source, arg_min(need / mass, class) AS c FROM limited WHERE NOT is_full GROUP BY source),
copies AS (
  SELECT l.source, l.class, l.source_size, l.target, CASE WHEN l.is_full THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, s.c * l.f) END AS m
  FROM limited l LEFT JOIN scales s ON l.source IS NOT DISTINCT FROM s.source),
drawn AS (
  SELECT d.doc_id, d.source, d.size, c.source_size, c.target, floor(c.m)::BIGINT AS whole, c.m - floor(c.m) AS p,
    (CAST('0x' || substr(md5('11:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM classed d JOIN copies c ON d.source IS NOT DISTINCT FROM c.source AND d.class = c.class),
keyed AS (
  SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) END AS q,
    round(target)::BIGINT - sum(size * whole) OVER (PARTITION BY source) AS words_left FROM drawn),
ranked AS (
  SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM keyed)
SELECT doc_id, size, source_size, target,
  (size * whole + CASE WHEN p > 0 THEN greatest(0, least(size, words_left - ahead)) ELSE 0 END)::BIGINT AS taken
FROM ranked
"""

SQL_OP9 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_paragraph_minhash": op1_paragraph_minhash,
        "op2_int8_embedding_dedup": op2_int8_embedding_dedup,
        "op3_hash_tree_sharding": op3_hash_tree_sharding,
        "op4_toxicity_lexicon": op4_toxicity_lexicon,
        "op5_prefix_doubling_dedup": op5_prefix_doubling_dedup,
        "op6_pareto_mixing": op6_pareto_mixing,
        "op7_piece_merge_dropout": op7_piece_merge_dropout,
        "op8_warc_packages": op8_warc_packages,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_simhash_popcount": op10_simhash_popcount,
        "op11_chat_formatting": op11_chat_formatting,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_ball_kmeans": op13_ball_kmeans,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_pareto_mixing": SQL_OP6, "op9_exact_dedup": SQL_OP9, "op11_chat_formatting": turn_sql.SQL_OP11, "op12_conversation_repair": turn_sql.SQL_OP12, "op13_ball_kmeans": turn_sql.SQL_OP13}
