"""Facts about tables: nulls, degrees, key checks, frequent words, name frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def degree(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """Most owners of one record, records with an owner, percent of the pool without."""
    g = edges.groupBy("mid").agg(F.count("*").alias("k")).agg(F.max("k").alias("most"), F.count("*").alias("matched"))
    n = pool.agg(F.count("*").alias("n"))
    return g.select("most", "matched", F.round(100.0 * (1 - F.col("matched") / n.scalar()), 6).alias("unlabelled"))


def country_mismatches(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select(F.col("entity_id").alias("s1"), F.col("country").alias("ca"))
    b = right.select(F.col("entity_id").alias("mid"), F.col("country").alias("cb"))
    return edges.join(a, "s1").join(b, "mid").agg(F.count("*").alias("edges"), F.count_if(F.col("ca") != F.col("cb")).alias("across"))


def wrong_prefixes(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that don't start with their source's prefix, by source."""
    rows = None
    for source, t in tables.items():
        x = t.agg(F.count_if(~F.col("entity_id").startswith(f"{source}-")).alias("wrong")).select(F.lit(source).alias("source"), "wrong")
        rows = x if rows is None else rows.unionByName(x)
    return rows


def top_tokens(df: DataFrame, without: list[str], k: int, column: str = "business_name") -> DataFrame:
    t = df.select(F.explode(F.split(F.lower(column), " ")).alias("tok")).filter(~F.col("tok").isin(without))
    return t.groupBy("tok").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tok").limit(k)


def name_frequency(df: DataFrame, column: str = "business_name") -> DataFrame:
    """How many records of the country have the same set of words; ``feature``: ln(1 + 100,000 / n * freq)."""
    key = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(column), " "))), " ")
    x = df.select("entity_id", "country", key.alias("k"))
    freq = x.groupBy("country", "k").agg(F.count("*").alias("freq"))
    n = df.groupBy("country").agg(F.count("*").alias("n"))
    return x.join(freq, ["country", "k"]).join(n, "country").withColumn("feature", F.log1p(1e5 / F.col("n") * F.col("freq")))


def report(sides: dict[str, DataFrame], records: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fact, value)``: rows by country, empty addresses, names, lengths and exact copies of each side; numbers of the links.

    ``records``: those whose matches are known (s1), ``edges``: (s1, mid). The last of ``sides`` holds the matches. A side
    without rows has zeros and no means.
    """
    from linkweave.functions.text import is_native, text

    number = lambda x: x.cast("double")
    facts = lambda df: df.unpivot([], list(df.columns), "fact", "value")
    out = None
    for name, rows in sides.items():
        one = rows.agg(
            number(F.count("*")).alias(f"{name}_rows"),
            number(F.count_if(F.trim(text("business_address")) == "")).alias(f"{name}_empty_address"),
            number(F.count_distinct("business_name")).alias(f"{name}_distinct_names"),
            F.round(F.avg(F.char_length("business_name")), 6).alias(f"{name}_mean_name"),
            F.round(F.avg(F.char_length("business_address")), 6).alias(f"{name}_mean_address"),
            number(F.max(F.char_length("business_name"))).alias(f"{name}_longest_name"),
            number(F.count_if(is_native("business_name"))).alias(f"{name}_native_names"),
            number(F.count("*") - F.count_distinct(F.xxhash64("business_name", text("business_address"), "country"))).alias(f"{name}_exact_copies"),
        )
        by = rows.groupBy("country").agg(number(F.count("*")).alias("value")).select(F.concat(F.lit(f"{name}_rows_"), F.lower("country")).alias("fact"), "value")
        both = facts(one).unionByName(by)
        out = both if out is None else out.unionByName(both)
    pool = list(sides.values())[-1]
    per = records.select("s1").join(edges.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    linked = edges.select(F.col("mid").alias("entity_id")).distinct()
    tables = [
        edges.agg(number(F.count("*")).alias("links")),
        per.agg(F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 6).alias("links_mean"), number(F.max("n")).alias("links_most"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("singletons_share")),
        edges.groupBy("mid").agg(F.count("*").alias("k")).agg(number(F.max("k")).alias("reused_most")),
        pool.join(linked, "entity_id", "left_anti").agg(number(F.count("*")).alias("unlinked_pool")),
        edges.join(pool.select(F.col("entity_id").alias("mid")), "mid", "left_anti").agg(number(F.count("*")).alias("dangling_links")),
    ]
    for t in tables:
        out = out.unionByName(facts(t))
    return out
