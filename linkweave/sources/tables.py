"""Reading the tables of a data directory, cutting lineage, and files in the shared folder of a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir`` (one file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, as the context uses it.

    Where none is named, a local session gets a temporary folder that goes with the process; a cluster gets an error, as
    a folder of one machine would be lost to the others.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="linkweave-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and continue from the copy.

    Survives the loss of executors, unlike a local checkpoint. The copies go when nothing refers to them any more where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, and with a local session's folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    For sides whose rows are exploded behind the last shuffle: Spark sizes them by the rows before, so a table that comes out
    many times the limit of a broadcast would be gathered by the driver.
    """
    return df.hint("merge")


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut`` for tables of many text or array columns: a copy holds compressed Arrow batches, as a checkpoint's rows are not compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_pydict({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield from pa.ipc.open_stream(x.as_buffer())

    return cut(df.mapInArrow(pack, "packed binary")).mapInArrow(unpack, df.schema)
