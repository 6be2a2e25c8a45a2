"""Scores of predicted pairs against true ones. A record without a match scores 1 if nothing is predicted for it, else 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def f_half(records: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``(s1, n, true_n, tp, f)`` of every record: F0.5 of its predicted (s1, cand) against its true (s1, cand)."""
    p = predicted.select("s1", "cand").distinct().withColumn("p", F.lit(1))
    t = truth.select("s1", "cand").distinct().withColumn("t", F.lit(1))
    both = p.join(t, ["s1", "cand"], "full").groupBy("s1").agg(F.sum("p").alias("n"), F.sum("t").alias("true_n"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    x = records.select("s1").join(both, "s1", "left").fillna(0, ["n", "true_n", "tp"])
    f = F.when(F.col("true_n") == 0, (F.col("n") == 0).cast("double")).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("true_n") + F.col("n")))
    return x.withColumn("f", f)


def macro(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Mean F0.5 of all records, of those with a match and of those without."""
    g = scores.groupBy(by) if by else scores.groupBy()
    with_match = F.col("true_n") > 0
    return g.agg(F.round(F.avg("f"), 6).alias("score"), F.round(F.avg(F.when(with_match, F.col("f"))), 6).alias("matched"), F.round(F.avg(F.when(~with_match, F.col("f"))), 6).alias("singletons"))


def recall(candidates: DataFrame, truth: DataFrame, by: str | None = None) -> DataFrame:
    """True pairs, those among the candidates, and their share; ``truth`` may carry a slice column ``by``."""
    hit = truth.join(candidates.select("s1", "cand").distinct().withColumn("hit", F.lit(1)), ["s1", "cand"], "left")
    g = hit.groupBy(by) if by else hit.groupBy()
    return g.agg(F.count("*").alias("pairs"), F.count("hit").alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall"))


def ceiling(records: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """The best macro F0.5 these candidates allow: all found matches predicted and nothing else."""
    found = truth.join(candidates.select("s1", "cand").distinct(), ["s1", "cand"], "left_semi")
    n = truth.groupBy("s1").agg(F.count("*").alias("n")).join(found.groupBy("s1").agg(F.count("*").alias("k")), "s1", "left").fillna(0, ["k"])
    r = F.col("k") / F.col("n")
    x = records.select("s1").join(n, "s1", "left")
    c = F.when(F.col("n").isNull(), 1.0).when(F.col("k") == 0, 0.0).otherwise(1.25 * r / (0.25 + r))
    return x.agg(F.round(F.avg(c), 6).alias("ceiling"))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """``(k, per_record, pooled)``: share of true pairs among each record's first k candidates (``r`` from 0)."""
    hit = truth.join(ranked.select("s1", "cand", "r"), ["s1", "cand"], "left")
    long = hit.select("s1", "r", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).withColumn("in", (F.coalesce("r", F.lit(1 << 30)) < F.col("k")).cast("double"))
    per = long.groupBy("k", "s1").agg(F.avg("in").alias("a"), F.sum("in").alias("s"), F.count("*").alias("n"))
    return per.groupBy("k").agg(F.round(F.avg("a"), 6).alias("per_record"), F.round(F.sum("s") / F.sum("n"), 6).alias("pooled"))


def true_ranks(buckets: DataFrame, truth: DataFrame) -> DataFrame:
    """``(s1, cand, r)`` of each true pair with a score: candidates of the record with a strictly higher score."""
    t = buckets.filter("score IS NOT NULL").join(truth.select("s1", F.col("mid").alias("cand")), ["s1", "cand"], "left_semi").select("s1", "cand", "score")
    j = t.join(buckets.select("s1", F.col("score").alias("other")), "s1")
    return j.groupBy("s1", "cand").agg(F.count_if(F.col("other") > F.col("score")).alias("r"))


def volume(records: DataFrame, predicted: DataFrame) -> DataFrame:
    """By country: share of records with a prediction, and predictions of those that have any."""
    n = predicted.groupBy("s1").agg(F.count("*").alias("n"))
    j = records.select(F.col("entity_id").alias("s1"), "country").join(n, "s1", "left")
    return j.groupBy("country").agg(F.round(F.avg(F.col("n").isNotNull().cast("double")), 6).alias("predicted"), F.round(F.avg("n"), 6).alias("matches"))


def baselines(records: DataFrame, ranked: DataFrame, truth: DataFrame, k: int, cosine: float) -> DataFrame:
    """``(rule, score)`` of predicting nothing, the first k, the pairs over a cosine, and everything found."""
    none = ranked.filter("false")
    found = ranked.join(truth, ["s1", "cand"], "left_semi")
    rules = {"nothing": none, f"top{k}": ranked.filter(F.col("r") < k), "cosine": ranked.filter(F.col("cosine") >= cosine), "ceiling": found}
    out = None
    for name, p in rules.items():
        x = macro(f_half(records, p, truth)).select(F.lit(name).alias("rule"), "score")
        out = x if out is None else out.unionByName(x)
    return out
