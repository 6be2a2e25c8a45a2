"""From probabilities to lists: owners, cutoffs, tuning, output lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_owner(pairs: DataFrame) -> DataFrame:
    """Of each candidate the pair of highest ``p``; ties go to the smaller record. Owners are found before any cutoff."""
    w = Window.partitionBy("cand").orderBy(F.desc("p"), "s1")
    return pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def cutoff(pairs: DataFrame, default: float, by_country: dict[str, float] | None = None) -> DataFrame:
    """Pairs with ``p`` at least their country's cutoff, or the default's."""
    t = F.lit(default)
    for country, value in (by_country or {}).items():
        t = F.when(F.col("country") == country, value).otherwise(t)
    return pairs.filter(F.col("p") >= t)


def ordered_lists(pairs: DataFrame) -> DataFrame:
    """``(s1, ids)``: candidates of each record, most probable first, joined by commas."""
    ids = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "cand")))
    return pairs.groupBy("s1").agg(F.array_join(F.transform(ids, lambda x: x["cand"]), ",").alias("ids"))


def submission(required: DataFrame, decided: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(s1, matches, candidates)`` of every required record, empty where there are none."""
    m = ordered_lists(decided).withColumnRenamed("ids", "matches")
    k = ordered_lists(candidates).withColumnRenamed("ids", "candidates")
    j = required.select(F.col("entity_id").alias("s1")).join(m, "s1", "left").join(k, "s1", "left")
    return j.select("s1", F.coalesce("matches", F.lit("")).alias("matches"), F.coalesce("candidates", F.lit("")).alias("candidates"))


def curve(owned: DataFrame, truth: DataFrame, records: DataFrame, grid: list[float], by: str | None = None) -> DataFrame:
    """``(t, score)``: macro F0.5 over all ``records`` (s1) if pairs with ``p >= t`` were predicted; ``by``: a column of ``records``, one curve a value.

    ``owned``: (s1, cand, p), ``truth``: (s1, cand). One pass: the pairs meet the truth once and the small grid is exploded
    on what is left, never the records.
    """
    over = [by] if by else []
    hits = owned.select("s1", "cand", "p").join(truth.select("s1", "cand").withColumn("hit", F.lit(1)), ["s1", "cand"], "left").select("s1", "p", F.coalesce("hit", F.lit(0)).alias("hit"))
    steps = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: t <= F.col("p")))
    at = hits.select("s1", "hit", steps.alias("t")).groupBy("s1", "t").agg(F.count("*").alias("n"), F.sum("hit").alias("tp"))
    size = truth.groupBy("s1").agg(F.count("*").alias("true_n"))
    x = at.join(records.select("s1", *over), "s1").join(size, "s1", "left").fillna(0, ["true_n"])
    # A record without a prediction at t scores 1 if it has no match, else 0: start from those and correct.
    base = records.join(size, "s1", "left").groupBy(*over).agg(F.count("*").alias("records"), F.count_if(F.col("true_n").isNull()).alias("singles"))
    f = F.when(F.col("tp") > 0, 1.25 * F.col("tp") / (0.25 * F.col("true_n") + F.col("n"))).otherwise(0.0)
    gain = f - F.when(F.col("true_n") == 0, 1.0).otherwise(0.0)
    g = x.withColumn("gain", gain).groupBy("t", *over).agg(F.sum("gain").alias("gain"))
    all_t = base.select("*", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("t"))
    return all_t.join(g, ["t", *over], "left").select("t", *over, F.round((F.coalesce("gain", F.lit(0.0)) + F.col("singles")) / F.col("records"), 6).alias("score"))


def tune(owned: DataFrame, truth: DataFrame, records: DataFrame, grid: list[float], by: str | None = None) -> DataFrame:
    """The cutoff of the best score, of each ``by`` if given; of equals the smallest."""
    scores, over = curve(owned, truth, records, grid, by), [by] if by else []
    best = F.max_by(F.struct("t", "score"), F.struct("score", (-F.col("t")).alias("_t"))).alias("x")
    return scores.groupBy(*over).agg(best).select("x.t", *over, "x.score")
