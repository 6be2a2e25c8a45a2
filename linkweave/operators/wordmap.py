"""Word maps: learning which transliterated word stands for which, and applying a map; the text a record is encoded by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions import text as T


def apply_map(words: Column, table: dict[str, str]) -> Column:
    """Each word by its entry of a small map, joined by spaces."""
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(m[w], w)), " ")


def apply_table(df: DataFrame, id_col: str, column: str, table: DataFrame) -> DataFrame:
    """``column`` with each word by its entry of ``table`` (t, e), a map of any size, by join."""
    words = df.select(id_col, F.posexplode(F.split(column, " ")).alias("i", "t")).join(table, "t", "left")
    done = words.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("e", "t").alias("w")))).alias("ws"))
    return df.drop(column).join(done.select(id_col, F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias(column)), id_col, "left")


def aligned_words(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``(t, e)``: words of two names of one business, that of each place on the left with all on the right of the same first letter."""
    t = pairs.select(F.explode(F.split(left, " ")).alias("t"), F.split(right, " ").alias("es"))
    return t.select("t", F.explode("es").alias("e")).filter((F.length("t") > 2) & (F.substring("t", 1, 1) == F.substring("e", 1, 1)))


def learn_map(pairs: DataFrame, least: int = 20, share: float = 0.6) -> DataFrame:
    """``(t, e, n)``: of each word the one it was seen with most, if seen ``least`` times and in ``share`` of all; ties: smaller word."""
    n = pairs.groupBy("t", "e").agg(F.count("*").alias("n"))
    w = Window.partitionBy("t")
    x = n.withColumn("all", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "e")))
    return x.filter((F.col("r") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).select("t", "e", "n")


def text_of(mode: str, name: str = "business_name", address: str = "business_address") -> Column:
    """The text a record is encoded by: raw, processed, latin or fixed (raw but for other scripts, which come out in Latin); the name alone without an address."""
    from linkweave.functions.script import transliterate_col

    if mode == "raw":
        n, a = F.col(name), F.col(address)
    elif mode == "processed":
        n, a = T.name_norm(name), T.addr_norm(address)
    else:
        n = F.when(T.is_native(name), transliterate_col(name)).otherwise(F.col(name) if mode == "fixed" else T.core_name(name))
        a = F.when(T.is_native(address), transliterate_col(address)).otherwise(F.col(address))
    return F.when(F.trim(F.coalesce(a, F.lit(""))) == "", n).otherwise(F.concat(n, F.lit(" | "), a))
