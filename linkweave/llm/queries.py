"""The registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import addresses, bpe, cosine_join, linkage, neighbors, packing, records, skeleton, topn, truncation, variants
from linkweave.sources.tables import cut_packed, table

FIELDS = ["business_name", "business_address"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.pairs(neighbors.most_similar(table(spark, sf_dir, "s1_embeddings"), "vec_id", "s1_embeddings"))


def _known(spark: SparkSession, sf_dir: str) -> tuple[list[tuple], dict[str, int]]:
    """The town reference and the common words of the clean source."""
    return records.gazetteer(spark, sf_dir), records.vocabulary(table(spark, sf_dir, "train_source1"))


def _parsed(spark: SparkSession, sf_dir: str, *names: str, known: tuple[list[tuple], dict[str, int]] | None = None) -> DataFrame:
    """Records of the named tables taken apart, by what is ``known`` of towns and common words."""
    places, words = known or _known(spark, sf_dir)
    columns = ["entity_id", "business_name", "business_address", "country"]
    rows = [table(spark, sf_dir, n).select(columns) for n in names]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return records.parse(out, places, words)


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of an S1 record with its confidence."""
    links = linkage.link(_parsed(spark, sf_dir, "train_source1"), _parsed(spark, sf_dir, "train_source2", "train_source3"))
    return links.select(F.col("a_id").alias("s1_entity_id"), F.col("b_id").alias("matched_entity_id"), F.round("confidence", 6).alias("confidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "train_matches").select(F.col("source1_entity_id").alias("s1_entity_id"))
    return p2_links(spark, sf_dir).select("s1_entity_id", "matched_entity_id").join(listed, "s1_entity_id", "left_anti")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = skeleton.odd_values(table(spark, sf_dir, "train_source2"), "entity_id", FIELDS)
    return odd.select("entity_id", "field").distinct()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.groups(table(spark, sf_dir, "train_source2"), "entity_id", FIELDS)


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each table is taken apart once; the clean records are those of the test split and of the first training source.
    known = _known(spark, sf_dir)
    test = cut_packed(_parsed(spark, sf_dir, "test_source1", known=known))
    train = cut_packed(_parsed(spark, sf_dir, "train_source1", "train_source2", "train_source3", known=known))
    return cosine_join.overlaps(test, train, test.unionByName(train.filter(F.col("entity_id").startswith("S1-"))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a_id"), F.col("b_id")
    return _overlaps(spark, sf_dir).select(F.least(a, b).alias("a_entity_id"), F.greatest(a, b).alias("b_entity_id")).distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_join.counts(_overlaps(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = variants.variant_groups(_parsed(spark, sf_dir, "train_source2", "train_source3"))
    return variants.across(groups, "S2-", "S3-").select(F.col("a_id").alias("s2_entity_id"), F.col("b_id").alias("s3_entity_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = addresses.same_building(_parsed(spark, sf_dir, "train_source2"), _parsed(spark, sf_dir, "train_source3"))
    return pairs.select(F.col("a_id").alias("s2_entity_id"), F.col("b_id").alias("s3_entity_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = topn.top_n(table(spark, sf_dir, "s1_buckets"), "s1_entity_id", "candidate_entity_id", "score", 10)
    return top.select("s1_entity_id", "candidate_entity_id")


P7_SQL = """
WITH best AS (
  SELECT s1_entity_id, candidate_entity_id, max(score) AS score FROM s1_buckets
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_entity_id ORDER BY score DESC, candidate_entity_id) AS r FROM best)
SELECT s1_entity_id, candidate_entity_id FROM ranked WHERE r <= 10
"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts back from their ids: (doc_id, text), null texts as empty ones."""
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))


P8_DECODED_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def p9_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pack_limits holds one row per container size, three in all; all its sizes are in tokens of byte_bpe_50k.
    rows = table(spark, sf_dir, "pack_limits").select("limit_id", "tokenizer", "capacity_tokens").collect()
    parts = [
        packing.fill(bpe.count_tokens(table(spark, sf_dir, "documents"), name=name), [(r[0], r[2]) for r in rows if r[1] == name])
        for name in sorted({r[1] for r in rows})
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p9_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each limit, the least number there can be, and the share of space left unused."""
    a = p9_assignment(spark, sf_dir).groupBy("limit_id", "capacity").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return a.select("limit_id", "containers", least.alias("least"), F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.shares(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = ["p1_found", "p2_found", "p2_links", "p3_found", "p3_groups", "p4_found", "p4_counts", "p5_found", "p6_found", "p7_found", "p8_ids", "p8_decoded", "p9_assignment", "p9_waste", "p10_found", "p10_shares"]
    return {n: globals()[n] for n in names}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL, "p8_decoded": P8_DECODED_SQL}
