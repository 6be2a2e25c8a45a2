"""Checks of output lists: one row a rule with the number of breaches and the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Breaches of a rule that are shown.
SHOWN = 3


def check(lines: DataFrame, header: str, required: DataFrame, known: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``(rule, n, examples)`` of the lines (value) of an output file: id, tab, ids between commas; one header among them.

    Rules: ``header`` - lines equal to the header are more or fewer than one; ``no_tab`` - lines with text and no tab;
    ``repeated_row``, ``repeated_id`` within a list, ``own_id`` (of the clean source), ``wrong_prefix``, ``unknown_id``,
    ``missing`` and ``extra`` records, and, a warning only, ``outside``: matches that are no candidates (s1, cand).
    Blank lines count for nothing.
    """
    said = lines.filter(F.trim("value") != "")
    rows = said.filter(F.contains("value", F.lit("\t")) & (F.col("value") != header))
    parts = F.split("value", "\t", 2)
    lists = rows.select(parts[0].alias("s1"), F.filter(F.split(F.get(parts, F.lit(1)), ","), lambda x: x != "").alias("ids"))
    items = lists.select("s1", F.explode("ids").alias("id")).distinct()
    needed = required.select(F.col("entity_id").alias("s1"))
    breaches = {
        "no_tab": said.filter(~F.contains("value", F.lit("\t"))).select("value"),
        "repeated_row": lists.groupBy("s1").agg(F.count("*").alias("n")).filter("n > 1").select("s1"),
        "repeated_id": lists.filter(F.size("ids") > F.size(F.array_distinct("ids"))).select("s1"),
        "own_id": items.filter(F.col("id").startswith("S1-")).select("id"),
        "wrong_prefix": items.filter(~F.col("id").rlike("^S[123]-")).select("id"),
        "unknown_id": items.filter(F.col("id").rlike("^S[23]-")).join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id"),
        "missing": needed.join(lists, "s1", "left_anti"),
        "extra": lists.join(needed, "s1", "left_anti").select("s1"),
    }
    if candidates is not None:
        breaches["outside"] = items.withColumnRenamed("id", "cand").join(candidates.select("s1", "cand"), ["s1", "cand"], "left_anti").select(F.concat_ws(" ", "s1", "cand"))
    heads = said.filter(F.col("value") == header).agg(F.abs(F.count("*") - 1).alias("n"))
    out = heads.select(F.lit("header").alias("rule"), "n", F.lit("").alias("examples"))
    for rule, found in breaches.items():
        x = found.toDF("x").distinct()
        # The first few are taken from every partition, so no list of all breaches is made.
        first = x.orderBy("x").limit(SHOWN).agg(F.array_join(F.array_sort(F.collect_list("x")), " | ").alias("examples"))
        out = out.unionByName(x.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n", first.scalar().alias("examples")))
    return out
