"""Records that arrive over time: deduplicated by watermark, blocked against a static table, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from linkweave.operators.blocking import _long_keys

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")] + [T.StructField("loaded_at", T.TimestampType())])


def arriving(spark: SparkSession, folder: str, schema: T.StructType = RECORD) -> DataFrame:
    """A stream of the Parquet files that land in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def once(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """Each record once, though delivered again up to ``delay`` later; state older than that is let go."""
    return stream.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["entity_id"])


def candidates(stream: DataFrame, clean: DataFrame, keys: tuple[str, ...] = ("hnum", "first_tok", "nprefix")) -> DataFrame:
    """``(s1, cand, k)``: arriving records with the clean records that share a lexical key; a stream-static join, no state."""
    left, right = _long_keys(clean, keys, "s1"), _long_keys(stream, keys, "cand").drop("prio")
    return right.join(left.drop("prio"), ["country", "k"]).select("s1", "cand", "k")


def append(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, appended to Parquet; a rerun goes on where the last one ended."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
