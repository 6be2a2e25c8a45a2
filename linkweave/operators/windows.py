"""Group-relative operators. Ranks are filtered as ``row_number() <= k`` first, so Spark prunes each group before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``r``: place in the group from 0."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def top(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their place ``r`` from 0. ``order`` must end in a unique key."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_n", n).filter(F.col("_n") <= k).withColumn("r", F.col("_n") - 1).drop("_n")


def candidate_side(df: DataFrame) -> DataFrame:
    """Of each ``(s1, cand, score)``: how the record ranks among the candidate's records, their number, best, second and margin.

    Margin: over the second for the best record (null when alone), else below the best.
    """
    w = Window.partitionBy("cand").orderBy(F.col("score").desc_nulls_last(), "s1")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = df.withColumns({"cand_rank": F.row_number().over(w) - 1, "cand_n_s1": F.count("*").over(Window.partitionBy("cand")), "best": F.first("score").over(whole), "second": F.nth_value("score", 2).over(whole)})
    return x.withColumn("margin", F.when(F.col("cand_rank") == 0, F.col("score") - F.col("second")).otherwise(F.col("score") - F.col("best")))


def competition_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """``r``: rows of the group with a higher value; null where the value is."""
    n = F.rank().over(Window.partitionBy(group).orderBy(F.col(value).desc_nulls_last())) - 1
    return df.withColumn("r", F.when(F.col(value).isNotNull(), n))


def dominated(df: DataFrame, group: str, item: str, a: str, b: str, by: float) -> DataFrame:
    """``better``: how many peers of its group have ``a`` no less and ``b`` at least ``by`` (over 0) more; ``(group, item, better)``.

    No pair of peers is ever made. Peers stand in the order of falling ``a``, so those with ``a`` no less are a head of
    that order, and a head is at most one block of each power of two. A peer is listed in the blocks that hold it, a row
    in the blocks of its head, and within a block a running count over falling ``b`` tells how many peers are ahead: rows
    times the logarithm of the group's size, however large it is. ``item`` must be unique in its group; a row with null
    ``a`` or ``b`` is no peer and has none.
    """
    whole = Window.partitionBy(group)
    order = whole.orderBy(F.desc("_a"), "_i")
    x = df.select(F.col(group), F.col(item).alias("_i"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    known = x.filter("_a IS NOT NULL AND _b IS NOT NULL")
    heads = whole.orderBy(F.desc("_a")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = known.select("*", (F.row_number().over(order) - 1).alias("_at"), F.count("*").over(heads).alias("_head"), F.count("*").over(whole).alias("_all"))
    levels = "sequence(0, char_length(bin(_all)) - 1)"
    # A head uses blocks of even number only: block 2j of a level where its size has that level's bit.
    held = f"transform(filter({levels}, k -> (shiftright(_at, k) & 1) = 0), k -> struct(k AS level, shiftright(_at, k) AS block, _b AS value, 1 AS peer))"
    asked = f"transform(filter({levels}, k -> (shiftright(_head, k) & 1) = 1), k -> struct(k AS level, 2 * shiftright(_head, k + 1) AS block, _b + {float(by)!r}D AS value, 0 AS peer))"
    rows = placed.select(group, "_i", F.explode(F.expr(f"concat({held}, {asked})")).alias("x")).select(group, "_i", "x.*")
    ahead = Window.partitionBy(group, "level", "block").orderBy(F.desc("value"), F.desc("peer")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.withColumn("_n", F.sum("peer").over(ahead)).filter("peer = 0").groupBy(group, "_i").agg(F.sum("_n").alias("better"))
    unknown = x.filter("_a IS NULL OR _b IS NULL").select(group, "_i", F.lit(0).cast("long").alias("better"))
    return counts.unionByName(unknown).withColumnRenamed("_i", item)
