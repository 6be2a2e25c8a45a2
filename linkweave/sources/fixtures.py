"""The three-source model over the tables of a data directory, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.sources.tables import table

RECORD = ["entity_id", "business_name", "business_address", "country"]

S1_SQL = "s1 AS (SELECT entity_id, business_name, business_address, country FROM train_source1)"
POOL_SQL = "pool AS (SELECT DISTINCT entity_id, business_name, business_address, country FROM (SELECT entity_id, business_name, business_address, country FROM train_source2 UNION ALL SELECT entity_id, business_name, business_address, country FROM train_source3))"
EDGES_SQL = "edges AS (SELECT source1_entity_id AS s1, unnest(string_split(matched_entity_ids, ',')) AS mid FROM train_matches WHERE matched_entity_ids <> '')"
BUCKET_SQL = """bk AS (SELECT s1_entity_id AS s1, candidate_entity_id AS cand, min(country) AS country, min(candidate_source) AS source,
  CAST(max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS DOUBLE) AS score, CAST(max(cosine) AS DOUBLE) AS cosine, min(rank) AS rank,
  min(e5_rank) AS e5_rank, min(rev_rank) AS rev_rank, max(addr_key) AS addr_key, min(name_rank) AS name_rank, max(num_key) AS num_key,
  min(empty_rank) AS empty_rank, min(empty_rev_rank) AS empty_rev_rank FROM s1_buckets GROUP BY 1, 2)"""
P_SQL = BUCKET_SQL + ", pr AS (SELECT s1, cand, country, score, greatest(0.0, least(1.0, round(coalesce(score, 0.0), 3))) AS p FROM bk)"


def s1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_source1").select(RECORD)


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Records of the noisy sources; one delivered twice is one record."""
    return table(spark, d, "train_source2").select(RECORD).unionByName(table(spark, d, "train_source3").select(RECORD)).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``(s1, mid)`` of the labelled matches; an empty list has no row."""
    m = table(spark, d, "train_matches").filter("matched_entity_ids <> ''")
    return m.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("mid"))


def buckets(spark: SparkSession, d: str) -> DataFrame:
    """One row per candidate pair; NaN scores are unknown; a pair delivered twice is one pair."""
    score = F.when(~F.isnan("score"), F.col("score"))
    ranks = [F.min(c).alias(c) for c in ("rank", "e5_rank", "rev_rank", "name_rank", "empty_rank", "empty_rev_rank")]
    return (
        table(spark, d, "s1_buckets")
        .groupBy(F.col("s1_entity_id").alias("s1"), F.col("candidate_entity_id").alias("cand"))
        .agg(
            F.min("country").alias("country"),
            F.min("candidate_source").alias("source"),
            F.max(score).cast("double").alias("score"),
            F.max("cosine").cast("double").alias("cosine"),
            *ranks,
            F.max("addr_key").alias("addr_key"),
            F.max("num_key").alias("num_key"),
        )
    )


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """``(s1, cand, country, score, p)`` with a closed-form p, the score cut to 0..1, for decisions with an exact oracle."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.coalesce("score", F.lit(0.0)), 3)))
    return buckets(spark, d).select("s1", "cand", "country", "score", p.alias("p"))
