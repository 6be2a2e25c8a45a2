"""Tab-separated sources and sinks: never quoted, every field a string, an absent value empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string TSV of one file or many, a header in the first or in each; quotes are ordinary characters; empty fields are empty strings.

    ``columns`` are the header's. Lines are split in the JVM; what is not selected afterwards is not cut out.
    """
    lines = spark.read.text(path).filter(F.col("value") != "\t".join(columns))
    return from_lines(lines, columns)


def id_list(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """``(id, n)``: distinct first fields of a TSV and the place of each one's first line in file order, from 0.

    Lines are numbered within their partition; only the partitions' line counts are summed over all of them.
    """
    lines = spark.read.text(path).select(F.split("value", "\t")[0].alias("id"), F.monotonically_increasing_id().alias("m"))
    if header is not None:
        lines = lines.filter(F.col("id") != header)
    lines = lines.select("id", F.shiftright("m", 33).alias("part"), F.col("m"))
    inside = Window.partitionBy("part").orderBy("m")
    sizes = lines.groupBy("part").agg(F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("n", F.row_number().over(inside) - 1).join(sizes.select("part", before.alias("before")), "part")
    return placed.groupBy("id").agg(F.min(F.col("before") + F.col("n")).alias("n"))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated part files, never quoted; null is an empty field, a tab or line end within one a space.

    The header is the first line of the first part file, so the files in order of name are one TSV; appending to files
    that are there adds none.
    """
    lines = to_lines(df, df.columns)
    if mode != "append" or not _exists(df.sparkSession, path):
        header = df.sparkSession.range(1, numPartitions=1).select(F.lit("\t".join(df.columns)).alias("value"))
        lines = header.unionAll(lines)
    lines.write.mode(mode).text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_by_country(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with one folder a country."""
    df.write.mode(mode).partitionBy("country").parquet(path)


def to_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as TSV lines in column ``value``; tabs and line ends inside a field become spaces."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ") for c in columns]
    return df.select(F.concat_ws("\t", *clean).alias("value"))


def from_lines(lines: DataFrame, columns: list[str]) -> DataFrame:
    parts = F.split("value", "\t", -1)
    return lines.select([F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def tolerant(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns; one that is absent is all empty."""
    return df.select([F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def required(ids: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per required id with its list, empty where there is none. ``ids`` (entity_id), ``lists`` (s1, ids)."""
    j = ids.join(lists.withColumnRenamed("s1", "entity_id"), "entity_id", "left")
    return j.select("entity_id", F.coalesce("ids", F.lit("")).alias("ids"))


def inventory(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """``(split, source, country columns)``: rows of the files called <split>_<source>, by what their names say, with a column a country."""
    paths = [f"{d}/{n}.parquet" for n in names]
    rows = None
    for path in paths:
        t = spark.read.parquet(path).select(F.input_file_name().alias("file"), F.coalesce("country", F.lit("")).alias("country"))
        rows = t if rows is None else rows.unionByName(t)
    said = r"([a-z]+)_(source\d+)\.parquet"
    counts = rows.groupBy(F.regexp_extract("file", said, 1).alias("split"), F.regexp_extract("file", said, 2).alias("source"), "country").count()
    p = counts.groupBy("split", "source").pivot("country").sum("count")
    return p.select("split", "source", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x.lower() or "none") for x in p.columns[2:]])
