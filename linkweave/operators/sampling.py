"""Samples that do not depend on partitioning: order by a hash of the id and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col))


def seeded_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.orderBy(hashed(id_col, seed), id_col)


def bucketed(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """The rows whose hash falls in the first ``share`` of a million buckets."""
    return df.filter(F.pmod(hashed(id_col, seed), F.lit(1_000_000)) < int(share * 1_000_000))


def per_group(df: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group."""
    w = Window.partitionBy(group).orderBy(hashed(id_col, seed), id_col)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def folds(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """``fold`` of each row; all rows of a group share one."""
    return df.withColumn("fold", F.pmod(hashed(group, seed), F.lit(k)).cast("int"))


def negatives_down(df: DataFrame, label: str, id_cols: list[str], ratio: float = 2.0, seed: int = 42) -> DataFrame:
    """All positives, and about ``ratio`` negatives for each, picked by hash without a global sort."""
    pos, n = F.sum(F.col(label).cast("long")), F.count("*")
    share = df.agg((ratio * pos / F.greatest(n - pos, F.lit(1))).alias("share")).scalar()
    u = F.pmod(F.xxhash64(F.lit(seed), *id_cols), F.lit(1_000_000)) / 1e6
    return df.filter((F.col(label).cast("int") == 1) | (u < share))


def stratified(df: DataFrame, stratum: str, id_col: str, size: int, floor_n: int = 20, floor_share: float = 0.01, seed: int = 42) -> DataFrame:
    """About ``size`` rows: of each stratum at least ``floor_n`` or ``floor_share``, the rest in proportion."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("all")).scalar()
    quota = F.greatest(F.lit(floor_n), F.ceil(floor_share * F.col("n")), F.floor(size * F.col("n") / total))
    quotas = counts.select(stratum, F.least("n", quota).alias("quota"))
    w = Window.partitionBy(stratum).orderBy(hashed(id_col, seed), id_col)
    return df.withColumn("_n", F.row_number().over(w)).join(quotas, stratum).filter(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def linked(clean: DataFrame, pool: DataFrame, edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A hashed sample of the clean records, all their true matches, and the same share of the pool's other records."""
    left = bucketed(clean, "entity_id", share, seed)
    own = edges.join(left.select(F.col("entity_id").alias("s1")), "s1", "left_semi").select(F.col("mid").alias("entity_id")).distinct()
    matched = pool.join(own, "entity_id", "left_semi")
    others = bucketed(pool.join(edges.select(F.col("mid").alias("entity_id")), "entity_id", "left_anti"), "entity_id", share, seed)
    return left.unionByName(matched).unionByName(others)


def tag_minimum(df: DataFrame, tags: dict[str, Column], id_col: str, size: int, least: float = 0.05, seed: int = 42) -> DataFrame:
    """About ``size`` rows with at least ``least`` of them of each tag (or all there are), filled up by hash order.

    Each part is the head of a hash order, which Spark takes from every partition and merges, without a full sort.
    """
    need = int(least * size)
    ids = None
    for tag in tags.values():
        head = df.filter(tag).orderBy(hashed(id_col, seed), id_col).limit(need).select(id_col)
        ids = head if ids is None else ids.unionByName(head)
    tagged = ids.distinct()
    rest = df.join(tagged, id_col, "left_anti").orderBy(hashed(id_col, seed), id_col).limit(max(0, size - tagged.count()))
    return df.join(tagged, id_col, "left_semi").unionByName(rest).limit(size)


def linked_share(df: DataFrame, kind: str, tags: dict[str, Column], id_col: str, size: int, share: float = 0.7, seed: int = 42) -> DataFrame:
    """About ``size`` rows, ``share`` of them of the kind ``linked`` and the rest ``no_match``, each with its least of every tag.

    What is missing of either is filled up from ``other_owner``, ``linked``, ``no_match`` and ``unlabeled``, in that order.
    """
    n = round(share * size)
    taken = tag_minimum(df.filter(F.col(kind) == "linked"), tags, id_col, n, seed=seed).unionByName(tag_minimum(df.filter(F.col(kind) == "no_match"), tags, id_col, size - n, seed=seed))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in ("other_owner", "linked", "no_match", "unlabeled")]), F.col(kind)), F.lit(0)), F.lit(9))
    rest = df.join(taken.select(id_col), id_col, "left_anti").orderBy(place, hashed(id_col, seed), id_col).limit(max(0, size - taken.count()))
    return taken.unionByName(rest)
