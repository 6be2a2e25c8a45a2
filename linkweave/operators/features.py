"""Features of candidate pairs. Null means unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions import similarity as S
from linkweave.functions import text as T
from linkweave.functions.script import transliterate_col
from linkweave.sources.tables import cut


def word_weights(records: DataFrame, column: str = "business_name") -> tuple[DataFrame, DataFrame]:
    """``(tok, idf)`` of the records' words, and ``(unseen)``, the weight of a word no record has."""
    toks = records.select("entity_id", F.explode(F.array_distinct(F.split(F.lower(column), " "))).alias("tok"))
    n = records.agg(F.count("*").alias("n"))
    df = toks.groupBy("tok").agg(F.count("*").alias("df"))
    return df.select("tok", (F.log((n.scalar() + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf")), n.select((F.log(F.col("n") + 1.0) + 1).alias("unseen"))


def _weighed(pairs: DataFrame, records: DataFrame) -> DataFrame:
    idf, unseen = word_weights(records)
    words = pairs.select("s1", "mid", F.explode(F.array_union("tx", "ty")).alias("tok"), "tx", "ty")
    return words.join(idf, "tok", "left").select("s1", "mid", "tok", F.array_contains("tx", F.col("tok")).alias("a"), F.array_contains("ty", F.col("tok")).alias("b"), F.coalesce("idf", unseen.scalar()).alias("w"))


def idf_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Weighted word overlap of pairs (s1, mid, tx, ty): one row a word, joined to its weight, so no word table is broadcast."""
    x = _weighed(pairs, records)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0.0))
    most = lambda cond: F.coalesce(F.max(F.when(cond, F.col("w"))), F.lit(0.0))
    a, b = F.col("a"), F.col("b")
    return x.groupBy("s1", "mid").agg(
        (total(a & b) / F.sum("w")).alias("jaccard"), (total(a & b) / F.nullif(total(a), F.lit(0.0))).alias("cover"), most(a & ~b).alias("miss_s1"), most(b & ~a).alias("miss_cand")
    )


def idf_pairs_typo(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The same where words a typo apart count as shared."""
    g = _weighed(pairs, records).groupBy("s1", "mid").agg(F.array_sort(F.collect_list(F.struct("tok", "w", "a", "b"))).alias("x"))
    side = lambda s: F.filter("x", lambda e: e[s])
    pick = lambda s, f: F.transform(side(s), lambda e: e[f])
    o = g.select("s1", "mid", S.idf_overlap_typo_col(pick("a", "tok"), pick("a", "w"), pick("b", "tok"), pick("b", "w")).alias("o"))
    return o.select("s1", "mid", *[F.round(f"o.{k}", 6).alias(k) for k in ("jaccard", "cover", "miss_s1", "miss_cand")])


def lexical_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Eight features of (s1, cand): three ratios from 0 to 1, three equal keys (unknown counts as 0), two gaps in length."""
    keep = ["name_clean", "addr_clean", "pin", "hnum", "first_tok"]
    a = T.with_keys(left).select(F.col("entity_id").alias("s1"), *[F.col(k).alias(f"a_{k}") for k in keep])
    b = T.with_keys(right).select(F.col("entity_id").alias("cand"), *[F.col(k).alias(f"b_{k}") for k in keep])
    equal = lambda k: F.coalesce(F.col(f"a_{k}") == F.col(f"b_{k}"), F.lit(False)).cast("int")
    gap = lambda k: F.abs(F.char_length(f"a_{k}") - F.char_length(f"b_{k}"))
    return pairs.join(a, "s1").join(b, "cand").select(
        "s1", "cand",
        (F.coalesce(S.ratio_col("a_name_clean", "b_name_clean"), F.lit(0.0)) / 100).alias("name_ratio"),
        (F.coalesce(S.token_set_col("a_name_clean", "b_name_clean"), F.lit(0.0)) / 100).alias("name_set"),
        (F.coalesce(S.ratio_col("a_addr_clean", "b_addr_clean"), F.lit(0.0)) / 100).alias("addr_ratio"),
        equal("pin").alias("pin"), equal("hnum").alias("hnum"), equal("first_tok").alias("first"), gap("name_clean").alias("name_gap"), gap("addr_clean").alias("addr_gap"),
    )


RELATIVE = ["addr_token_set", "addr_idf_cover", "street_name_token_set", "name_token_set", "name_idf_cover"]
SEARCHES = ["e5_rank", "rev_rank", "addr_key", "name_rank", "num_key", "empty_rank", "empty_rev_rank"]


def _record_side(df: DataFrame) -> DataFrame:
    """What a pair needs of one record, made once a record: derived columns, word sets, street, tags."""
    x = T.processed(df.withColumns({"business_name": T.text("business_name"), "business_address": T.text("business_address")}))
    st = T.street_of("business_address")
    digits = F.array_distinct(F.filter(T.words("business_address"), lambda w: w.rlike("[0-9]")))
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    # Only names in another script go through Arrow.
    x = x.withColumn("name_lat", F.when(T.is_native("business_name"), transliterate_col("name_lat")).otherwise(F.col("name_lat")))
    return x.withColumns({
        "raw_name": F.lower("business_name"), "raw_addr": F.lower("business_address"), "compact": T.compact_of("domain_stem", "name_lat", "name_norm"), "streets": split("street_tokens"), "numbers": digits,
        "post": T.postcode_last("business_address"), "street_name": st["street"], "street_no": st["house"], "name_words": F.array_distinct(split("name_norm")), "addr_words": F.array_distinct(split("addr_norm")),
        "native": T.is_native("business_name").cast("int"), "web": ((F.col("domain_stem") != "") | T.is_handle("business_name")).cast("int"), "word_set": F.array_join(F.array_sort(F.array_distinct(split("name_norm"))), " "),
    })


def _weights_joined(df: DataFrame, column: str, idf: DataFrame, out: str) -> DataFrame:
    """``out``: map of each record's words to their weight; a word without one is left to the default."""
    w = df.select("entity_id", "country", F.explode(column).alias("tok")).join(idf, ["country", "tok"], "left")
    m = w.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", F.coalesce("idf", unseen.scalar()).alias("w")))).alias(out)) if "unseen" in idf.columns else w.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", F.coalesce("idf", F.lit(12.0)).alias("w")))).alias(out))
    return df.join(m, "entity_id", "left")


def pair_features(bucket: DataFrame, left: DataFrame, right: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The feature frame of (s1, cand) pairs of a bucket table, of the records in ``only`` (s1) if given: 85 columns, null where unknown.

    Everything that depends on one record is made once a record, before the pairs; candidate-side statistics come from
    the whole bucket table, before any sampling. Two Arrow passes (text ratios, typo overlap); the rest is native.
    """
    from linkweave.operators.windows import candidate_side, dominated

    sizes = left.groupBy("country").agg(F.count("*").alias("n"))

    def idf_of(side: DataFrame, column: str) -> DataFrame:
        toks = side.select("country", F.explode(column).alias("tok")).groupBy("country", "tok").agg(F.count("*").alias("df"))
        return toks.join(sizes, "country").select("country", "tok", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))

    a, b = _record_side(left), _record_side(right)
    freq = a.groupBy("country", "word_set").agg(F.count("*").alias("freq")).join(sizes, "country")
    name_idf, addr_idf = idf_of(a, "name_words"), idf_of(a, "addr_words")
    scaled = F.log1p(1e5 / F.col("n") * F.col("freq"))

    def ready(side: DataFrame) -> DataFrame:
        x = _weights_joined(side, "name_words", name_idf, "name_w")
        x = _weights_joined(x, "addr_words", addr_idf, "addr_w")
        return x.join(freq.select("country", "word_set", scaled.alias("name_freq")), ["country", "word_set"], "left")

    need = ["name_norm", "core_name", "name_lat", "raw_name", "compact", "phonetic_code", "legal_form", "addr_norm", "raw_addr", "streets", "numbers", "post", "house_no", "city", "state_code", "street_name", "street_no", "name_words", "addr_words", "name_w", "addr_w", "name_freq", "native", "web", "empty_addr", "has_honorific", "landmark_flag"]
    pa = ready(a).select(F.col("entity_id").alias("s1"), F.struct(*need).alias("a"))
    pb = ready(b).select(F.col("entity_id").alias("cand"), F.struct(*need).alias("b"))
    sides = candidate_side(bucket)
    sides = sides if only is None else sides.join(only.select("s1"), "s1", "left_semi")
    # By candidate first, as the pairs stand by then; the pairs go over the network once more, by record, with one side only.
    p = sides.join(pb, "cand").join(pa, "s1")
    x, y = (lambda k: F.col(f"a.{k}")), (lambda k: F.col(f"b.{k}"))

    def overlap(kind: str) -> dict:
        weight = lambda w: F.coalesce(F.col(f"a.{kind}_w")[w], F.col(f"b.{kind}_w")[w], F.lit(12.0))
        exact = S.idf_overlap(x(f"{kind}_words"), y(f"{kind}_words"), weight)
        return {f"{kind}_idf_{k}": v for k, v in exact.items()}

    def fuzzy(kind: str):
        weights = lambda side: F.transform(F.col(f"{side}.{kind}_words"), lambda w: F.coalesce(F.col(f"{side}.{kind}_w")[w], F.lit(12.0)))
        return S.idf_overlap_typo_col(x(f"{kind}_words"), weights("a"), y(f"{kind}_words"), weights("b"))

    w = Window.partitionBy("s1")
    ordered = w.orderBy(F.col("score").desc_nulls_last(), "cand")
    f = p.withColumns({
        "rank": F.row_number().over(ordered) - 1, "s1_best_cosine": F.max("cosine").over(w), "gap_to_best_score": F.max("score").over(w) - F.col("score"),
        "gap_to_next_score": F.col("score") - F.lead("score").over(ordered), "cand_margin": F.col("margin"),
        "name_ratio": S.ratio_col(x("name_norm"), y("name_norm")), "name_token_set": S.token_set_col(x("name_norm"), y("name_norm")), "name_token_sort": S.token_sort_col(x("name_norm"), y("name_norm")),
        "name_partial": S.partial_col(x("name_norm"), y("name_norm")), "s1_name_len": F.char_length(x("name_norm")), "cand_name_len": F.char_length(y("name_norm")),
        "core_ratio": S.ratio_col(x("core_name"), y("core_name")), "core_jaro_winkler": S.jaro_winkler_col(x("core_name"), y("core_name")),
        "latin_ratio": S.ratio_col(x("name_lat"), y("name_lat")), "latin_token_set": S.token_set_col(x("name_lat"), y("name_lat")), "raw_name_token_set": S.token_set_col(x("raw_name"), y("raw_name")),
        "compact_ratio": S.ratio_col(x("compact"), y("compact")), "compact_partial": S.partial_col(x("compact"), y("compact")),
        "phonetic_same": S.same(x("phonetic_code"), y("phonetic_code")), "legal_form_same": S.same(x("legal_form"), y("legal_form")),
        "addr_ratio": S.ratio_col(x("addr_norm"), y("addr_norm")), "addr_token_set": S.token_set_col(x("addr_norm"), y("addr_norm")), "raw_addr_token_set": S.token_set_col(x("raw_addr"), y("raw_addr")),
        "raw_addr_partial": S.partial_col(x("raw_addr"), y("raw_addr")), "cand_addr_len": F.char_length(y("addr_norm")),
        "street_jaccard": S.jaccard(x("streets"), y("streets")), "street_cover": S.cover(x("streets"), y("streets")), "numbers_jaccard": S.jaccard(x("numbers"), y("numbers")), "numbers_cover": S.cover(x("numbers"), y("numbers")),
        "postcode_same": S.same(x("post"), y("post")), "house_no_same": S.same(x("house_no"), y("house_no")), "city_same": S.same(x("city"), y("city")), "state_same": S.same(x("state_code"), y("state_code")),
        "cand_is_s3": (F.col("source") == "S3").cast("int"), "cand_native_script": y("native"), "cand_web_name": y("web"), "cand_empty_address": y("empty_addr"), "cand_honorific": y("has_honorific"), "cand_landmark": y("landmark_flag"),
        **overlap("name"), **overlap("addr"), "name_fuzzy": fuzzy("name"), "addr_fuzzy": fuzzy("addr"),
        "street_name_token_set": S.token_set_col(x("street_name"), y("street_name")), "street_name_ratio": S.ratio_col(x("street_name"), y("street_name")), "house_number_same": S.same(x("street_no"), y("street_no")),
        "s1_name_freq": F.coalesce(x("name_freq"), F.lit(0.0)), "cand_name_freq": F.coalesce(y("name_freq"), F.lit(0.0)),
    })
    f = f.withColumn("s1_top5_cosine", F.avg(F.when(F.col("rank") < 5, F.col("cosine"))).over(w))
    f = f.withColumns({f"{kind}_idf_{k}_fuzzy": F.col(f"{kind}_fuzzy.{k}") for kind in ("name", "addr") for k in ("jaccard", "cover", "miss_s1", "miss_cand")})
    relative = {}
    for k in RELATIVE:
        relative[f"{k}_gap_best"] = F.max(k).over(w) - F.col(k)
        relative[f"{k}_rank"] = F.when(F.col(k).isNotNull(), F.rank().over(w.orderBy(F.col(k).desc_nulls_last())) - 1)
    twins = lambda k: F.sum(F.when(F.col(k) >= 90, 1).otherwise(0)).over(w)
    f = f.withColumns({**relative, "n_name_twins": twins("name_token_set"), "n_addr_twins": twins("addr_token_set"), "_name": F.coalesce("name_token_set", F.lit(-1.0)), "_addr": F.coalesce("addr_token_set", F.lit(-1.0))})
    columns = FEATURES()
    # Only the features are kept: the sides of a pair are many times as large.
    f = cut(f.select("s1", "cand", "country", "_name", "_addr", *[k for k in columns if k != "better_addr_same_name"]))
    better = dominated(f.select("s1", "cand", "_name", "_addr"), "s1", "cand", "_name", "_addr", 10.0)
    f = f.join(better.withColumnRenamed("better", "better_addr_same_name"), ["s1", "cand"])
    return f.select("s1", "cand", "country", *columns)


def FEATURES() -> list[str]:
    """The 85 feature names in order."""
    idf = [f"{kind}_idf_{k}{suffix}" for suffix in ("", "_fuzzy") for kind in ("name", "addr") for k in ("jaccard", "cover", "miss_s1", "miss_cand")]
    base = "rank score cosine s1_best_cosine gap_to_best_score gap_to_next_score s1_top5_cosine cand_n_s1 cand_rank cand_margin name_ratio name_token_set name_token_sort name_partial s1_name_len cand_name_len core_ratio core_jaro_winkler latin_ratio latin_token_set raw_name_token_set compact_ratio compact_partial phonetic_same legal_form_same addr_ratio addr_token_set raw_addr_token_set raw_addr_partial cand_addr_len street_jaccard street_cover numbers_jaccard numbers_cover postcode_same house_no_same city_same state_same cand_is_s3 cand_native_script cand_web_name cand_empty_address cand_honorific cand_landmark".split()
    rest = ["street_name_token_set", "street_name_ratio", "house_number_same", "s1_name_freq", "cand_name_freq", *SEARCHES]
    relative = [f"{k}_{s}" for k in RELATIVE for s in ("gap_best", "rank")]
    return [*base, *idf, *rest, *relative, "n_name_twins", "n_addr_twins", "better_addr_same_name"]


def feature_set(name: str) -> list[str]:
    """Named subsets: all, without the group-relative ones (submission2), the first 44 (base)."""
    columns = FEATURES()
    return {"all": columns, "submission2": columns[:61], "base": columns[:44]}[name]
