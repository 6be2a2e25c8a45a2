"""Same postal address written differently: expanded forms meet on shared hashes, conflicts are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.linkage import _variants
from linkweave.llm.pairs import compare, side
from linkweave.llm.records import STREET_TYPES, fold
from linkweave.sources.tables import cut

#: Letters of a street that one cut off is met by.
CUT = 5
PARTS = ["country", "house", "suffix", "street", "kind", "way", "town", "pin"]


def buildings(parsed: DataFrame) -> DataFrame:
    """Distinct addresses that have a number, a street and a place, each with an id: copies of one address are one row."""
    whole = parsed.filter((F.col("house") != "") & (F.col("street") != "") & (F.col("town").isNotNull() | (F.col("pin") != "")))
    return whole.withColumn("place", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in PARTS]))


def expansions() -> Column:
    """All plausible forms of a street: as it is, with any one letter left out, by its first letter and type, cut off, run together with its type."""
    has_kind = F.col("kind") != ""
    folded = F.create_map(*[F.lit(x) for k in STREET_TYPES for x in (k, fold(k))])
    more = F.array(
        F.concat_ws("|", F.lit("^"), F.substring("street", 1, 1), "kind"),
        F.when(F.char_length("street") >= CUT, F.concat_ws("|", F.lit("<"), F.substring("street", 1, CUT))),
        F.when(has_kind, F.concat("street", folded[F.col("kind")])),
        # A street that ends in its type is one whose type was run together with it.
        F.when(~has_kind, F.regexp_replace("street", f"(?:{'|'.join(sorted({fold(k) for k in STREET_TYPES}))})$", "")),
    )
    return F.array_distinct(F.filter(F.concat(_variants("street"), F.array_compact(more)), lambda f: f != ""))


def forms(places: DataFrame) -> DataFrame:
    """``(place, h)``: hashes of the combinations of number, each form of the street, and the place, by town and by postcode.

    A combination needs what it is made of: an address without a known town has those by postcode only, and the other way
    round.
    """
    street = places.withColumn("form", F.explode(expansions()))
    by_town = F.when(F.col("town").isNotNull(), F.xxhash64(F.lit("t"), "country", "town", "house", "form"))
    by_pin = F.when(F.col("pin") != "", F.xxhash64(F.lit("p"), "country", "pin", "house", "form"))
    return street.select("place", F.explode(F.array_compact(F.array(by_town, by_pin))).alias("h")).distinct()


def same_building(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a_id, b_id)``: records of ``left`` and ``right`` (parsed) whose addresses denote one building and are not equal as stored.

    Every distinct address is expanded into all its forms; forms that share a hash meet by equi-join; pairs whose house
    numbers (with their letters), streets, directions, towns or postcodes conflict are rejected. Unit, floor and landmark
    were taken off in parsing. Addresses without number, street or place, null and blank ones are in no pair. Distinct
    addresses stand for their copies until the records are listed.
    """
    left, right = cut(buildings(left)), cut(buildings(right))
    blank = {c: F.lit("") for c in ("core", "letters", "whole", "site")}
    a = left.dropDuplicates(["place"]).withColumns(blank).withColumns({"common": F.array().cast("array<string>"), "initials": F.lit(False)})
    b = right.dropDuplicates(["place"]).withColumns(blank).withColumns({"common": F.array().cast("array<string>"), "initials": F.lit(False)})
    meet = forms(a).select(F.col("place").alias("a_place"), "h").join(forms(b).select(F.col("place").alias("b_place"), "h"), "h").select("a_place", "b_place").distinct()
    equal = meet.filter("a_place = b_place")
    rows = meet.filter("a_place <> b_place").join(a.select(F.col("place").alias("a_place"), side().alias("a")), "a_place").join(b.select(F.col("place").alias("b_place"), side().alias("b")), "b_place")
    votes = compare(rows, ["a_place", "b_place"])
    kept = votes.filter("v_house = 1 and v_street = 1 and v_town >= 0 and not (v_town = 0 and v_pin <= 0)").select("a_place", "b_place")
    links = kept.unionByName(equal)
    x = left.select(F.col("place").alias("a_place"), F.col("entity_id").alias("a_id"), F.col("address").alias("a_address"))
    y = right.select(F.col("place").alias("b_place"), F.col("entity_id").alias("b_id"), F.col("address").alias("b_address"))
    return links.join(x, "a_place").join(y, "b_place").filter("a_address <> b_address").select("a_id", "b_id").distinct()
