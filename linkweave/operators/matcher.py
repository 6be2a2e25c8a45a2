"""Boosted trees over pair features: fit, out-of-fold scores, transfer between countries, importance."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.sampling import folds


def assemble(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``features``: each column with unknown as -1, and whether it is known."""
    value = [F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(-1.0)) for c in columns]
    known = [F.col(c).isNotNull().cast("double") for c in columns]
    return pairs.withColumn("features", array_to_vector(F.array(*value, *known)))


def fit(train: DataFrame, columns: list[str], label: str = "is_true", rounds: int = 40, depth: int = 6, seed: int = 42, held: float = 0.1, patience: float = 0.01) -> GBTClassificationModel:
    """Boosted trees of 2^``depth`` leaves at most. Fitting stops early where the loss on the ``held`` share of records gains under ``patience``.

    The held-out share is of whole records (s1), by hash; without that column, or where it would leave nothing to hold
    out, all ``rounds`` are fitted.
    """
    gbt = GBTClassifier(labelCol="_y", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, subsamplingRate=0.8, maxMemoryInMB=512)
    by = F.col("s1") if "s1" in train.columns else F.monotonically_increasing_id()
    rows = assemble(train, columns).select("features", F.col(label).cast("double").alias("_y"), (F.pmod(F.xxhash64(F.lit(seed + 1), by), F.lit(1000)) < int(1000 * held)).alias("_held")).persist()
    try:
        kinds = {(r["_held"], r["_y"]) for r in rows.select("_held", "_y").distinct().collect()}
        if held and {(True, 0.0), (True, 1.0), (False, 0.0), (False, 1.0)} <= kinds:
            gbt = gbt.setParams(validationIndicatorCol="_held", validationTol=patience)
        return gbt.fit(rows)
    finally:
        rows.unpersist()


def predict(model: GBTClassificationModel, pairs: DataFrame, columns: list[str]) -> DataFrame:
    scored = model.transform(assemble(pairs, columns))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(pairs: DataFrame, columns: list[str], label: str = "is_true", k: int = 3, rounds: int = 40, seed: int = 42) -> DataFrame:
    """``p`` of every pair from a model that saw no pair of its record. The k models are fitted one after another."""
    split = folds(pairs, "s1", k, seed)
    out = None
    for i in range(k):
        model = fit(split.filter(F.col("fold") != i), columns, label, rounds, seed=seed)
        part = predict(model, split.filter(F.col("fold") == i), columns)
        out = part if out is None else out.unionByName(part)
    return out


def transfer(pairs: DataFrame, columns: list[str], country: str, label: str = "is_true", rounds: int = 40) -> DataFrame:
    """Scores of one country's pairs by a model of the others."""
    return predict(fit(pairs.filter(F.col("country") != country), columns, label, rounds), pairs.filter(F.col("country") == country), columns)


def importance(model: GBTClassificationModel, columns: list[str]) -> list[tuple[str, float, int]]:
    """Gain and number of splits of each column, its own and its being known together."""
    gain, n = model.featureImportances.toArray(), len(columns)
    splits = [0] * (2 * n)
    for tree in model.trees:
        for at in re.findall(r"If \(feature (\d+) ", tree.toDebugString):
            splits[int(at)] += 1
    return sorted(((c, float(gain[i] + gain[i + n]), splits[i] + splits[i + n]) for i, c in enumerate(columns)), key=lambda x: (-x[1], x[0]))
