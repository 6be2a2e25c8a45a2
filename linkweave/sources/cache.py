"""Reuse of a stored result where what it was made from is unchanged."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reuse(path: str, inputs: DataFrame, settings: dict, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """The result for ``inputs`` (an id and the texts it depends on) under ``settings``, and whether it was stored already.

    ``path`` holds the result, the inputs and the settings. They are reused if the settings are equal and neither side has
    an input row more than the other; else the result is built and stored anew. Repeated rows count as often as they occur.
    """
    spark, said = inputs.sparkSession, json.dumps(settings, sort_keys=True)
    try:
        stored = spark.read.parquet(f"{path}/inputs")
        same = stored.columns == inputs.columns and spark.read.text(f"{path}/settings").first()[0] == said
        if same and stored.exceptAll(inputs).isEmpty() and inputs.exceptAll(stored).isEmpty():
            return spark.read.parquet(f"{path}/result"), True
    except AnalysisException:
        pass
    build(inputs).write.mode("overwrite").parquet(f"{path}/result")
    inputs.write.mode("overwrite").parquet(f"{path}/inputs")
    spark.range(1).select(F.lit(said).alias("value")).write.mode("overwrite").text(f"{path}/settings")
    return spark.read.parquet(f"{path}/result"), False
