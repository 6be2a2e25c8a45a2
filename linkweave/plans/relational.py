"""Queries of scans, projections, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.operators import windows as W
from linkweave.plans.registry import query
from linkweave.sources import fixtures as X
from linkweave.sources import tsv
from linkweave.sources.fixtures import BUCKET_SQL, EDGES_SQL, P_SQL, POOL_SQL, S1_SQL
from linkweave.sources.tables import scratch, table

c = F.col


def r6(x):
    return F.round(x, 6)


# ---- scans and sinks


def stored_tsv(spark: SparkSession, df: DataFrame) -> str:
    path = scratch(spark, "tsv")
    tsv.write_tsv(df, path)
    return path


@query("SELECT entity_id, business_name FROM train_source1 WHERE country = 'India'")
def src_tsv_lazy(spark: SparkSession, d: str) -> DataFrame:
    path = stored_tsv(spark, X.s1(spark, d))
    return tsv.read_tsv(spark, path, X.RECORD).filter("country = 'India'").select("entity_id", "business_name")


@query("SELECT entity_id, regexp_replace(coalesce(business_name, ''), '[\t\r\n]', ' ', 'g') AS business_name, regexp_replace(coalesce(business_address, ''), '[\t\r\n]', ' ', 'g') AS business_address FROM train_source3")
def src_tsv_raw(spark: SparkSession, d: str) -> DataFrame:
    columns = ["entity_id", "business_name", "business_address"]
    return tsv.read_tsv(spark, stored_tsv(spark, table(spark, d, "train_source3").select(columns)), columns)


@query("SELECT entity_id, country, '' AS absent FROM train_source2")
def src_parquet(spark: SparkSession, d: str) -> DataFrame:
    return tsv.tolerant(table(spark, d, "train_source2"), ["entity_id", "country", "absent"])


@query("SELECT s1_entity_id, candidate_entity_id, rank FROM s1_buckets WHERE rank < 5")
def src_pq_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "s1_buckets").filter("rank < 5").select("s1_entity_id", "candidate_entity_id", "rank")


@query("SELECT entity_id, business_name FROM train_source1 WHERE entity_id IN (SELECT source1_entity_id FROM train_matches)")
def src_pq_isin(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "train_matches").select(c("source1_entity_id").alias("entity_id"))
    return X.s1(spark, d).join(ids, "entity_id", "left_semi").select("entity_id", "business_name")


@query("""SELECT split, source, count(*) FILTER (country = 'France') AS france, count(*) FILTER (country = 'India') AS india, count(*) FILTER (country = 'US') AS us FROM (
SELECT 'train' AS split, 'source1' AS source, country FROM train_source1 UNION ALL SELECT 'train', 'source2', country FROM train_source2
UNION ALL SELECT 'train', 'source3', country FROM train_source3 UNION ALL SELECT 'test', 'source1', country FROM test_source1) GROUP BY 1, 2""")
def src_inventory(spark: SparkSession, d: str) -> DataFrame:
    return tsv.inventory(spark, d, ["train_source1", "train_source2", "train_source3", "test_source1"])


@query("SELECT 'train_source1' AS name, count(*) AS n FROM train_source1 UNION ALL SELECT 'place_ref', count(*) FROM place_ref UNION ALL SELECT 'documents', count(*) FROM documents")
def src_discover(spark: SparkSession, d: str) -> DataFrame:
    """Tables found by name under a folder, and their rows."""
    from linkweave.sources.discover import find

    rows = [spark.read.parquet(find(f"{n}.parquet", [d])).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("train_source1", "place_ref", "documents")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query("SELECT country, entity_id, business_name FROM train_source1 UNION ALL SELECT country, entity_id, business_name FROM test_source1")
def snk_pq_append(spark: SparkSession, d: str) -> DataFrame:
    """Two batches appended to one Parquet table with a folder a country, and read back."""
    path = scratch(spark, "appended")
    for name in ("train_source1", "test_source1"):
        tsv.write_by_country(table(spark, d, name).select("entity_id", "business_name", "country"), path, "append")
    return spark.read.parquet(path).select("country", "entity_id", "business_name")


@query("SELECT entity_id, business_name FROM test_source1 WHERE country = 'France'")
def snk_pq_country(spark: SparkSession, d: str) -> DataFrame:
    """One country of a table with a folder a country: the filter prunes the other folders."""
    path = scratch(spark, "by-country")
    tsv.write_by_country(table(spark, d, "test_source1").select("entity_id", "business_name", "country"), path)
    return spark.read.parquet(path).filter("country = 'France'").select("entity_id", "business_name")


@query("SELECT source1_entity_id AS id, row_number() OVER (ORDER BY source1_entity_id) - 1 AS n FROM train_matches")
def src_idlist(spark: SparkSession, d: str) -> DataFrame:
    path = stored_tsv(spark, table(spark, d, "train_matches").select("source1_entity_id", "matched_entity_ids").orderBy("source1_entity_id"))
    return tsv.id_list(spark, path, "source1_entity_id")


@query(f"""WITH {EDGES_SQL} SELECT s.entity_id || chr(9) || coalesce(string_agg(e.mid, ',' ORDER BY e.mid), '') AS line
FROM train_source1 s LEFT JOIN edges e ON e.s1 = s.entity_id GROUP BY s.entity_id UNION ALL SELECT 'entity_id' || chr(9) || 'ids'""")
def snk_tsv(spark: SparkSession, d: str) -> DataFrame:
    lists = X.edges(spark, d).groupBy("s1").agg(F.array_join(F.sort_array(F.collect_list("mid")), ",").alias("ids"))
    path = stored_tsv(spark, tsv.required(X.s1(spark, d).select("entity_id"), lists))
    return spark.read.text(path).select(c("value").alias("line"))


@query("SELECT entity_id || chr(9) || country AS line FROM train_source1 UNION ALL SELECT entity_id || chr(9) || country FROM test_source1 UNION ALL SELECT 'entity_id' || chr(9) || 'country'")
def snk_tsv_append(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tsv")
    for name in ("train_source1", "test_source1"):
        tsv.write_tsv(table(spark, d, name).select("entity_id", "country"), path, "append")
    return spark.read.text(path).select(c("value").alias("line"))


@query("SELECT country, count(*) AS n, round(avg(length(business_name)), 6) AS mean FROM train_source2 GROUP BY 1")
def snk_csv(spark: SparkSession, d: str) -> DataFrame:
    """A metric table written as CSV with a header and as JSON lines, and both read back: they must agree."""
    m = table(spark, d, "train_source2").groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg(F.char_length("business_name")), 6).alias("mean"))
    path = scratch(spark, "metrics")
    m.write.csv(f"{path}/csv", header=True)
    m.write.json(f"{path}/json")
    kind = "country string, n bigint, mean double"
    return spark.read.csv(f"{path}/csv", header=True, schema=kind).intersect(spark.read.schema(kind).json(f"{path}/json"))


@query("SELECT vec_id, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings UNION ALL SELECT -1, max(len(embedding))::INT, round(sum(list_sum(embedding::DOUBLE[])) / count(*), 5) FROM embeddings")
def snk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and their mean stored as array columns and read back; the mean's row has the id -1."""
    from linkweave.operators.dense import mean_vector

    path, e = scratch(spark, "vectors"), table(spark, d, "embeddings").select("vec_id", "embedding")
    e.write.parquet(path)
    back = spark.read.parquet(path)
    spark.createDataFrame([(-1, mean_vector(back, "embedding"))], "vec_id bigint, embedding array<double>").write.parquet(f"{path}-mean")
    both = back.select("vec_id", c("embedding").cast("array<double>").alias("v")).unionAll(spark.read.parquet(f"{path}-mean"))
    return both.select("vec_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""WITH a AS (SELECT entity_id, business_name FROM train_source1), b AS (SELECT entity_id, CASE WHEN entity_id = (SELECT min(entity_id) FROM a) THEN business_name || '!' ELSE business_name END AS business_name FROM a),
d AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT step, CASE step WHEN 'same' THEN true WHEN 'changed' THEN (SELECT n = 0 FROM d) ELSE false END AS reused, (SELECT sum(length(business_name)) FROM a) + CASE WHEN step IN ('changed', 'settings') THEN 1 ELSE 0 END AS letters
FROM (VALUES ('first'), ('same'), ('changed'), ('settings')) s(step)""")
def src_cache(spark: SparkSession, d: str) -> DataFrame:
    """A stored result asked for again, with one text changed, and under other settings: what was reused, and what came out."""
    from linkweave.sources.cache import reuse

    a = X.s1(spark, d).select("entity_id", "business_name")
    least = a.agg(F.min("entity_id")).first()[0]
    b = a.withColumn("business_name", F.when(c("entity_id") == least, F.concat("business_name", F.lit("!"))).otherwise(c("business_name")))
    path, out = scratch(spark, "cache"), None
    build = lambda x: x.select("entity_id", F.char_length("business_name").alias("n"))
    for step, inputs, settings in (("first", a, {"mode": "raw"}), ("same", a, {"mode": "raw"}), ("changed", b, {"mode": "raw"}), ("settings", b, {"mode": "latin"})):
        result, reused = reuse(path, inputs, settings, build)
        row = spark.createDataFrame([(step, reused, result.agg(F.sum("n")).first()[0])], "step string, reused boolean, letters bigint")
        out = row if out is None else out.unionAll(row)
    return out


# ---- projections, filters, casts


@query("SELECT entity_id AS id, upper(country) AS country, business_name || ' | ' || coalesce(business_address, '') AS text FROM train_source2")
def prj_expr(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_source2").drop("loaded_at")
    t = t.withColumns({"text": F.concat(c("business_name"), F.lit(" | "), F.coalesce("business_address", F.lit(""))), "country": F.upper("country")})
    return t.withColumnsRenamed({"entity_id": "id"}).drop("business_name", "business_address")


@query("""SELECT entity_id, CASE WHEN regexp_matches(business_name, '[\\x{0900}-\\x{0DFF}]') THEN 'native' WHEN regexp_matches(lower(business_name), '^[a-z0-9-]+[.][a-z.]+$') THEN 'domain'
WHEN regexp_matches(lower(business_name), '^ *(smt|shri|mr|mrs|miss|dr)[.]? ') THEN 'honorific' ELSE 'plain' END AS tag FROM train_source3""")
def prj_case(spark: SparkSession, d: str) -> DataFrame:
    n = c("business_name")
    tag = F.when(n.rlike(r"[\x{0900}-\x{0DFF}]"), "native").when(F.lower(n).rlike("^[a-z0-9-]+[.][a-z.]+$"), "domain")
    return table(spark, d, "train_source3").select("entity_id", tag.when(F.lower(n).rlike("^ *(smt|shri|mr|mrs|miss|dr)[.]? "), "honorific").otherwise("plain").alias("tag"))


@query(f"""WITH {BUCKET_SQL} SELECT s1, cand, CASE WHEN e5_rank IS NOT NULL AND rev_rank IS NOT NULL THEN 'both' WHEN e5_rank IS NOT NULL THEN 'forward'
WHEN rev_rank IS NOT NULL THEN 'reverse' ELSE 'extra' END AS kind FROM bk""")
def prj_select_multi(spark: SparkSession, d: str) -> DataFrame:
    e, r = c("e5_rank").isNotNull(), c("rev_rank").isNotNull()
    return X.buckets(spark, d).select("s1", "cand", F.when(e & r, "both").when(e, "forward").when(r, "reverse").otherwise("extra").alias("kind"))


@query("SELECT entity_id, coalesce(nullif(trim(business_address), ''), nullif(business_name, ''), '?') AS text FROM train_source2")
def prj_nullfill(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.nullif(F.trim("business_address"), F.lit("")), F.nullif("business_name", F.lit("")), F.lit("?"))
    return table(spark, d, "train_source2").select("entity_id", text.alias("text"))


@query("""SELECT entity_id FROM train_source3 WHERE country IN ('US', 'India') AND entity_id LIKE 'S3-%' AND business_address IS NOT NULL
AND regexp_matches(business_address, '[0-9]{3}') AND NOT starts_with(business_name, 'M')""")
def flt_pred(spark: SparkSession, d: str) -> DataFrame:
    a, n = c("business_address"), c("business_name")
    keep = c("country").isin("US", "India") & c("entity_id").startswith("S3-") & a.isNotNull() & a.rlike("[0-9]{3}") & ~n.startswith("M")
    return table(spark, d, "train_source3").filter(keep).select("entity_id")


@query(f"WITH {BUCKET_SQL} SELECT s1, cand FROM bk WHERE e5_rank < 10 OR e5_rank IS NULL")
def flt_keep_src(spark: SparkSession, d: str) -> DataFrame:
    return X.buckets(spark, d).filter((c("e5_rank") < 10) | c("e5_rank").isNull()).select("s1", "cand")


@query(f"WITH {BUCKET_SQL} SELECT s1, cand FROM bk WHERE e5_rank IS NOT NULL OR rev_rank <= 1 OR addr_key = 1 OR name_rank IS NOT NULL")
def flt_sub2(spark: SparkSession, d: str) -> DataFrame:
    older = c("e5_rank").isNotNull() | (c("rev_rank") <= 1) | (c("addr_key") == 1) | c("name_rank").isNotNull()
    return X.buckets(spark, d).filter(older).select("s1", "cand")


@query("SELECT postcode, coalesce(TRY_CAST(postcode AS SMALLINT), 0)::INT AS small, coalesce(TRY_CAST(postcode AS INTEGER), 0) AS number, coalesce(TRY_CAST(region_code AS INTEGER), -1) AS code FROM place_ref")
def cast_num(spark: SparkSession, d: str) -> DataFrame:
    p = c("postcode")
    return table(spark, d, "place_ref").select(
        "postcode",
        F.coalesce(p.try_cast("smallint"), F.lit(0)).cast("int").alias("small"),
        F.coalesce(p.try_cast("int"), F.lit(0)).alias("number"),
        F.coalesce(c("region_code").try_cast("int"), F.lit(-1)).alias("code"),
    )


@query("SELECT entity_id FROM train_source1 ORDER BY entity_id LIMIT 10 OFFSET 5")
def lim_head(spark: SparkSession, d: str) -> DataFrame:
    return X.s1(spark, d).select("entity_id").orderBy("entity_id").offset(5).limit(10)


# ---- joins


@query(f"""WITH {S1_SQL}, {POOL_SQL}, a AS (SELECT entity_id, country, nullif(regexp_extract(business_address, '([0-9]{{5,6}})', 1), '') AS pin FROM s1),
b AS (SELECT entity_id, country, nullif(regexp_extract(business_address, '([0-9]{{5,6}})', 1), '') AS pin FROM pool)
SELECT a.entity_id AS s1, b.entity_id AS cand, a.pin FROM a JOIN b ON a.country = b.country AND a.pin = b.pin""")
def jn_inner_key(spark: SparkSession, d: str) -> DataFrame:
    pin = F.nullif(F.regexp_extract("business_address", "([0-9]{5,6})", 1), F.lit(""))
    a = X.s1(spark, d).select(c("entity_id").alias("s1"), "country", pin.alias("pin"))
    b = X.pool(spark, d).select(c("entity_id").alias("cand"), "country", pin.alias("pin"))
    return a.join(b, ["country", "pin"]).select("s1", "cand", "pin")


@query(f"WITH {BUCKET_SQL}, {POOL_SQL} SELECT s1, cand, business_name AS cand_name FROM bk LEFT JOIN pool ON pool.entity_id = bk.cand")
def jn_left_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = X.pool(spark, d).select(c("entity_id").alias("cand"), c("business_name").alias("cand_name"))
    return X.buckets(spark, d).select("s1", "cand").join(names, "cand", "left").select("s1", "cand", "cand_name")


@query("SELECT entity_id FROM train_source1 WHERE EXISTS (SELECT 1 FROM s1_buckets b WHERE b.s1_entity_id = entity_id)")
def jn_semi(spark: SparkSession, d: str) -> DataFrame:
    return X.s1(spark, d).select("entity_id").join(table(spark, d, "s1_buckets").select(c("s1_entity_id").alias("entity_id")), "entity_id", "left_semi")


@query("SELECT entity_id FROM train_source1 WHERE NOT EXISTS (SELECT 1 FROM s1_buckets b WHERE b.s1_entity_id = entity_id)")
def jn_anti(spark: SparkSession, d: str) -> DataFrame:
    return X.s1(spark, d).select("entity_id").join(table(spark, d, "s1_buckets").select(c("s1_entity_id").alias("entity_id")), "entity_id", "left_anti")


STOP_SQL = "SELECT country, split_part(lower(business_name), ' ', 1) AS tok FROM train_source1 GROUP BY 1, 2 HAVING count(*) > 3"


@query(f"""WITH stop AS ({STOP_SQL}) SELECT s.entity_id, CASE WHEN stop.tok IS NULL THEN split_part(lower(s.business_name), ' ', 1) END AS tok
FROM train_source1 s LEFT JOIN stop ON stop.country = s.country AND stop.tok = split_part(lower(s.business_name), ' ', 1)""")
def jn_stopmask(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.blocking import mask_stops, stop_keys

    t = X.s1(spark, d).select("entity_id", "country", F.split(F.lower("business_name"), " ")[0].alias("tok"))
    return mask_stops(t, stop_keys(t, "tok", 3), "tok").select("entity_id", "tok")


@query(f"""WITH {S1_SQL}, {POOL_SQL}, k AS (SELECT entity_id, country, lower(business_name) AS k FROM pool), ok AS (SELECT country, k FROM k GROUP BY 1, 2 HAVING count(*) <= 3)
SELECT s1.entity_id AS s1, k.entity_id AS cand FROM k JOIN ok USING (country, k) JOIN s1 ON s1.country = k.country AND lower(s1.business_name) = k.k""")
def jn_capped(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.blocking import capped_join

    k = F.lower("business_name").alias("k")
    return capped_join(X.s1(spark, d).select("entity_id", "country", k), X.pool(spark, d).select("entity_id", "country", k), ["country", "k"], 3)


@query("SELECT entity_id, coalesce(m.iso, '??') AS iso FROM test_source1 LEFT JOIN (VALUES ('US', 'USA'), ('India', 'IND')) m(country, iso) USING (country)")
def jn_map(spark: SparkSession, d: str) -> DataFrame:
    iso = F.create_map(*[F.lit(x) for x in ("US", "USA", "India", "IND")])
    return table(spark, d, "test_source1").select("entity_id", F.coalesce(iso[c("country")], F.lit("??")).alias("iso"))


@query("""WITH w AS (SELECT DISTINCT entity_id, country, unnest(string_split(lower(business_name), ' ')) AS tok FROM train_source1),
v AS (SELECT DISTINCT entity_id, country, unnest(string_split(lower(business_name), ' ')) AS tok FROM test_source1)
SELECT w.entity_id AS s1, v.entity_id AS other, tok FROM w JOIN v USING (country, tok) WHERE length(tok) >= 4""")
def jn_token_explode(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.blocking import tokens

    # A word counts once for an id, however many rows it has; what is cut to parts by word is made distinct there and joined there.
    words = lambda t: tokens(t).filter(F.length("tok") >= 4).repartition("country", "tok").distinct()
    a, b = words(X.s1(spark, d)), words(table(spark, d, "test_source1"))
    return a.withColumnRenamed("entity_id", "s1").join(b.withColumnRenamed("entity_id", "other"), ["country", "tok"]).select("s1", "other", "tok")


@query(f"WITH {BUCKET_SQL}, {EDGES_SQL} SELECT bk.s1, cand FROM bk JOIN edges ON edges.s1 = bk.s1 AND edges.mid = cand")
def jn_pair_hit(spark: SparkSession, d: str) -> DataFrame:
    return X.buckets(spark, d).select("s1", "cand").join(X.edges(spark, d).withColumnRenamed("mid", "cand"), ["s1", "cand"])


# ---- aggregates


@query("SELECT country, count(*) AS n FROM train_source2 GROUP BY 1 ORDER BY n DESC, country LIMIT 5")
def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_source2").groupBy("country").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "country").limit(5)


@query("SELECT count(*) FILTER (business_name IS NULL) AS business_name, count(*) FILTER (business_address IS NULL) AS business_address, count(*) FILTER (country IS NULL) AS country FROM train_source3")
def agg_nullcount(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.profile import null_counts

    return null_counts(table(spark, d, "train_source3"), ["business_name", "business_address", "country"])


@query(f"""WITH {EDGES_SQL}, n AS (SELECT source1_entity_id AS s1, count(e.mid) AS k FROM train_matches LEFT JOIN edges e ON e.s1 = source1_entity_id GROUP BY 1)
SELECT round(avg(k), 6) AS mean, max(k) AS most, median(k) AS middle, round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END), 6) AS singletons FROM n""")
def agg_stats(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "train_matches").select(c("source1_entity_id").alias("s1"))
    k = m.join(X.edges(spark, d), "s1", "left").groupBy("s1").agg(F.count("mid").alias("k"))
    return k.agg(r6(F.avg("k")).alias("mean"), F.max("k").alias("most"), F.median("k").alias("middle"), r6(F.avg((c("k") == 0).cast("double"))).alias("singletons"))


@query("SELECT sum((length(matched_entity_ids) - length(replace(matched_entity_ids, 'S2-', ''))) / 3)::BIGINT AS s2, sum((length(matched_entity_ids) - length(replace(matched_entity_ids, 'S3-', ''))) / 3)::BIGINT AS s3 FROM train_matches")
def agg_strcount(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.sum(F.regexp_count("matched_entity_ids", F.lit(p))).alias(p[:2].lower())
    return table(spark, d, "train_matches").agg(n("S2-"), n("S3-"))


@query(f"""WITH {EDGES_SQL}, {POOL_SQL}, g AS (SELECT mid, count(*) AS k FROM edges GROUP BY 1)
SELECT max(k) AS most, count(*) AS matched, round(100.0 * (1 - count(*) / (SELECT count(*) FROM pool)::DOUBLE), 6) AS unlabelled FROM g""")
def agg_degree(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.profile import degree

    return degree(X.edges(spark, d), X.pool(spark, d))


@query(f"""WITH {EDGES_SQL}, {POOL_SQL} SELECT count(*) AS edges, count(*) FILTER (a.country <> b.country) AS across FROM edges
JOIN train_source1 a ON a.entity_id = edges.s1 JOIN pool b ON b.entity_id = edges.mid""")
def agg_fk_check(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.profile import country_mismatches

    return country_mismatches(X.edges(spark, d), X.s1(spark, d), X.pool(spark, d))


@query("""SELECT 'S1' AS source, count(*) FILTER (entity_id NOT LIKE 'S1-%') AS wrong FROM train_source1 UNION ALL
SELECT 'S2', count(*) FILTER (entity_id NOT LIKE 'S2-%') FROM train_source2 UNION ALL SELECT 'S3', count(*) FILTER (entity_id NOT LIKE 'S3-%') FROM train_source3""")
def agg_prefix_check(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.profile import wrong_prefixes

    return wrong_prefixes({f"S{i}": table(spark, d, f"train_source{i}") for i in (1, 2, 3)})


@query("""WITH t AS (SELECT unnest(string_split(lower(business_name), ' ')) AS tok FROM train_source1) SELECT tok, count(*) AS n FROM t
WHERE tok NOT IN ('', '&', 'llc', 'ltd', 'inc', 'corp', 'limited', 'private', 'llp') GROUP BY 1 ORDER BY n DESC, tok LIMIT 20""")
def agg_toptokens(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.profile import top_tokens

    return top_tokens(X.s1(spark, d), ["", "&", "llc", "ltd", "inc", "corp", "limited", "private", "llp"], 20)


@query("SELECT string_split(lower(business_name), ' ')[-1] AS tok, count(*) AS n FROM train_source1 GROUP BY 1 ORDER BY n DESC, tok LIMIT 10")
def agg_lasttokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.element_at(F.split(F.lower("business_name"), " "), -1).alias("tok")
    return X.s1(spark, d).groupBy(t).agg(F.count("*").alias("n")).orderBy(c("n").desc(), "tok").limit(10)


@query("SELECT s1_entity_id AS s1, count(DISTINCT candidate_entity_id) AS cands, string_agg(DISTINCT candidate_source, ',' ORDER BY candidate_source) AS sources FROM s1_buckets GROUP BY 1")
def agg_list(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "s1_buckets").groupBy(c("s1_entity_id").alias("s1"))
    return g.agg(F.count_distinct("candidate_entity_id").alias("cands"), F.array_join(F.array_sort(F.collect_set("candidate_source")), ",").alias("sources"))


@query(f"WITH {P_SQL} SELECT s1, string_agg(cand, ',' ORDER BY p DESC, cand) AS ids FROM pr WHERE p >= 0.5 GROUP BY 1")
def agg_list_ordered(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.decide import ordered_lists

    return ordered_lists(X.probabilities(spark, d).filter("p >= 0.5"))


@query("""WITH w AS (SELECT DISTINCT entity_id, country, unnest(string_split(lower(business_name), ' ')) AS tok FROM train_source1), n AS (SELECT country, count(*) AS n FROM train_source1 GROUP BY 1)
SELECT country, tok, round(ln((n + 1.0) / (count(*) + 1.0)) + 1, 6) AS idf FROM w JOIN n USING (country) GROUP BY country, tok, n""")
def agg_idf(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.blocking import idf, tokens

    t = X.s1(spark, d)
    return idf(tokens(t), t.groupBy("country").agg(F.count("*").alias("n"))).select("country", "tok", r6("idf").alias("idf"))


@query("""WITH k AS (SELECT entity_id, country, array_to_string(list_sort(list_distinct(string_split(lower(business_name), ' '))), ' ') AS k FROM train_source1),
f AS (SELECT country, k, count(*) AS freq FROM k GROUP BY 1, 2), n AS (SELECT country, count(*) AS n FROM train_source1 GROUP BY 1)
SELECT entity_id, freq, round(ln(1 + 1e5 / n * freq), 6) AS feature FROM k JOIN f USING (country, k) JOIN n USING (country)""")
def agg_namefreq(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.profile import name_frequency

    return name_frequency(X.s1(spark, d)).select("entity_id", "freq", r6("feature").alias("feature"))


@query("SELECT count(DISTINCT s1_entity_id) AS s1, count(DISTINCT candidate_entity_id) AS cands FROM s1_buckets")
def agg_nunique(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "s1_buckets").agg(F.count_distinct("s1_entity_id").alias("s1"), F.count_distinct("candidate_entity_id").alias("cands"))


@query(f"""WITH {P_SQL}, k AS (SELECT s1, count(*) AS n FROM pr WHERE p >= 0.6 GROUP BY 1)
SELECT country, round(avg(CASE WHEN k.n IS NULL THEN 0.0 ELSE 1.0 END), 6) AS predicted, round(avg(k.n), 6) AS matches FROM train_source1 s LEFT JOIN k ON k.s1 = s.entity_id GROUP BY 1""")
def agg_volume(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.metrics import volume

    return volume(X.s1(spark, d), X.probabilities(spark, d).filter("p >= 0.6"))


@query(f"""WITH {BUCKET_SQL} SELECT source, round(avg(cosine) FILTER (country = 'India'), 6) AS india, round(avg(cosine) FILTER (country = 'US'), 6) AS us FROM bk GROUP BY 1""")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = X.buckets(spark, d).groupBy("source").pivot("country", ["India", "US"]).agg(r6(F.avg("cosine")))
    return p.withColumnsRenamed({"India": "india", "US": "us"})


@query(f"""WITH {BUCKET_SQL} SELECT source, round(quantile_cont(cosine, 0.1), 6) AS p10, round(quantile_cont(cosine, 0.5), 6) AS p50, round(quantile_cont(cosine, 0.9), 6) AS p90 FROM bk GROUP BY 1""")
def agg_describe(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: r6(F.percentile("cosine", F.lit(p))).alias(f"p{int(p * 100)}")
    return X.buckets(spark, d).groupBy("source").agg(q(0.1), q(0.5), q(0.9))


@query("""SELECT country, round(100 * avg(CASE WHEN coalesce(trim(business_address), '') = '' THEN 1.0 ELSE 0.0 END), 6) AS empty_address,
round(100 * avg(CASE WHEN business_name = upper(business_name) THEN 1.0 ELSE 0.0 END), 6) AS upper_name FROM train_source3 GROUP BY 1""")
def agg_tagshare(spark: SparkSession, d: str) -> DataFrame:
    share = lambda tag: r6(100 * F.avg(tag.cast("double")))
    g = table(spark, d, "train_source3").groupBy("country")
    empty = F.coalesce(F.trim("business_address"), F.lit("")) == ""
    return g.agg(share(empty).alias("empty_address"), share(c("business_name") == F.upper("business_name")).alias("upper_name"))


@query("""WITH x AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) SELECT (i - 1)::INT AS i, round(avg(v::DOUBLE), 6) AS mean FROM x GROUP BY 1""")
def agg_mean_vector(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    return x.groupBy("i").agg(r6(F.avg(c("v").cast("double"))).alias("mean"))


# ---- windows


@query(f"WITH {BUCKET_SQL} SELECT s1, cand, (row_number() OVER (PARTITION BY s1 ORDER BY score DESC NULLS LAST, cand) - 1)::INT AS r FROM bk")
def win_rownum(spark: SparkSession, d: str) -> DataFrame:
    return W.ranked(X.buckets(spark, d), "s1", [c("score").desc_nulls_last(), c("cand")]).select("s1", "cand", "r")


@query(f"WITH {BUCKET_SQL} SELECT s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY addr_key DESC, num_key DESC, cand) AS r FROM bk) WHERE r <= 4")
def win_cap(spark: SparkSession, d: str) -> DataFrame:
    return W.top(X.buckets(spark, d), "s1", [c("addr_key").desc(), c("num_key").desc(), c("cand")], 4).select("s1", "cand")


@query(f"WITH {BUCKET_SQL} SELECT s1, cand, (r - 1)::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY cosine DESC NULLS LAST, cand) AS r FROM bk) WHERE r <= 5")
def win_topk_row(spark: SparkSession, d: str) -> DataFrame:
    return W.top(X.buckets(spark, d), "s1", [c("cosine").desc_nulls_last(), c("cand")], 5).select("s1", "cand", "r")


CAND_SQL = """cs AS (SELECT s1, cand, score, (row_number() OVER w - 1)::INT AS cand_rank, count(*) OVER (PARTITION BY cand) AS cand_n_s1,
first_value(score) OVER w AS best, nth_value(score, 2) OVER (PARTITION BY cand ORDER BY score DESC NULLS LAST, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM bk WINDOW w AS (PARTITION BY cand ORDER BY score DESC NULLS LAST, s1))"""


@query(f"WITH {BUCKET_SQL}, {CAND_SQL} SELECT s1, cand, cand_rank, cand_n_s1, round(best, 6) AS best, round(second, 6) AS second FROM cs")
def win_candrank(spark: SparkSession, d: str) -> DataFrame:
    return W.candidate_side(X.buckets(spark, d)).select("s1", "cand", "cand_rank", "cand_n_s1", r6("best").alias("best"), r6("second").alias("second"))


@query(f"WITH {BUCKET_SQL}, {CAND_SQL} SELECT s1, cand, round(CASE WHEN cand_rank = 0 THEN score - second ELSE score - best END, 6) AS margin FROM cs")
def win_margin(spark: SparkSession, d: str) -> DataFrame:
    return W.candidate_side(X.buckets(spark, d)).select("s1", "cand", r6("margin").alias("margin"))


@query(f"WITH {BUCKET_SQL} SELECT s1, cand, round(score - lead(score) OVER (PARTITION BY s1 ORDER BY score DESC NULLS LAST, cand), 6) AS gap FROM bk")
def win_lead(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("s1").orderBy(c("score").desc_nulls_last(), "cand")
    return X.buckets(spark, d).select("s1", "cand", r6(c("score") - F.lead("score").over(w)).alias("gap"))


@query(f"WITH {BUCKET_SQL} SELECT s1, cand, round(max(score) OVER (PARTITION BY s1) - score, 6) AS gap FROM bk")
def win_maxgap(spark: SparkSession, d: str) -> DataFrame:
    return X.buckets(spark, d).select("s1", "cand", r6(F.max("score").over(Window.partitionBy("s1")) - c("score")).alias("gap"))


@query(f"WITH {BUCKET_SQL} SELECT s1, cand, round(avg(CASE WHEN rank < 5 THEN cosine END) OVER (PARTITION BY s1), 6) AS top5 FROM bk")
def win_top5mean(spark: SparkSession, d: str) -> DataFrame:
    return X.buckets(spark, d).select("s1", "cand", r6(F.avg(F.when(c("rank") < 5, c("cosine"))).over(Window.partitionBy("s1"))).alias("top5"))


@query(f"WITH {BUCKET_SQL} SELECT s1, cand, CASE WHEN cosine IS NOT NULL THEN (rank() OVER (PARTITION BY s1 ORDER BY cosine DESC NULLS LAST) - 1)::INT END AS r FROM bk")
def win_minrank(spark: SparkSession, d: str) -> DataFrame:
    return W.competition_rank(X.buckets(spark, d), "s1", "cosine").select("s1", "cand", "r")


@query(f"WITH {BUCKET_SQL} SELECT s1, cand, sum(CASE WHEN cosine >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY s1)::INT AS twins FROM bk")
def win_twins(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum(F.when(c("cosine") >= 0.9, 1).otherwise(0)).over(Window.partitionBy("s1"))
    return X.buckets(spark, d).select("s1", "cand", n.cast("int").alias("twins"))


@query(f"""WITH {BUCKET_SQL}, x AS (SELECT s1, cand, coalesce(score, -1) AS a, coalesce(cosine, -1) AS b FROM bk)
SELECT x.s1, x.cand, count(y.cand) AS better FROM x LEFT JOIN x y ON y.s1 = x.s1 AND y.cand <> x.cand AND y.a >= x.a AND y.b >= x.b + 0.05 GROUP BY 1, 2""")
def win_dominated(spark: SparkSession, d: str) -> DataFrame:
    x = X.buckets(spark, d).select("s1", "cand", F.coalesce("score", F.lit(-1.0)).alias("a"), F.coalesce("cosine", F.lit(-1.0)).alias("b"))
    return W.dominated(x, "s1", "cand", "a", "b", 0.05)


@query(f"WITH {P_SQL} SELECT cand, s1, p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM pr) WHERE r = 1")
def win_oneowner(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.decide import one_owner

    return one_owner(X.probabilities(spark, d)).select("cand", "s1", "p")


@query(f"WITH {BUCKET_SQL} SELECT cand, s1 FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY cosine DESC NULLS LAST, s1) AS r FROM bk) WHERE r = 1")
def win_owner_cos(spark: SparkSession, d: str) -> DataFrame:
    return W.top(X.buckets(spark, d), "cand", [c("cosine").desc_nulls_last(), c("s1")], 1).select("cand", "s1")


@query("""SELECT entity_id, business_name, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY loaded_at) AS r FROM train_source2) WHERE r = 1""")
def win_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    return W.top(table(spark, d, "train_source2"), "entity_id", [c("loaded_at")], 1).select("entity_id", "business_name", "loaded_at")


@query("""SELECT country, entity_id FROM (SELECT country, entity_id, row_number() OVER (PARTITION BY country ORDER BY length(business_name) DESC, entity_id) AS r FROM train_source1) WHERE r <= 10""")
def win_head_group(spark: SparkSession, d: str) -> DataFrame:
    return W.top(X.s1(spark, d), "country", [F.length("business_name").desc(), c("entity_id")], 10).select("country", "entity_id")


@query(f"""WITH {BUCKET_SQL}, {EDGES_SQL}, t AS (SELECT bk.s1, cand, score FROM bk JOIN edges ON edges.s1 = bk.s1 AND mid = cand WHERE score IS NOT NULL)
SELECT t.s1, t.cand, count(bk.cand) AS r FROM t LEFT JOIN bk ON bk.s1 = t.s1 AND bk.score > t.score GROUP BY 1, 2""")
def win_recallrank(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.metrics import true_ranks

    return true_ranks(X.buckets(spark, d), X.edges(spark, d))


# ---- sorts and set operations


@query(f"WITH {BUCKET_SQL} SELECT s1, cand, score FROM bk WHERE score IS NOT NULL ORDER BY score DESC, s1, cand")
def srt_multi(spark: SparkSession, d: str) -> DataFrame:
    return X.buckets(spark, d).filter("score IS NOT NULL").select("s1", "cand", "score").orderBy(c("score").desc(), "s1", "cand")


@query()
def shuf_seeded(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.sampling import seeded_order

    return seeded_order(X.s1(spark, d).select("entity_id"), "entity_id", 42)


@query("SELECT entity_id, NULL::TIMESTAMP AS loaded_at FROM train_source1 UNION ALL SELECT entity_id, loaded_at FROM train_source2")
def set_unionall(spark: SparkSession, d: str) -> DataFrame:
    return X.s1(spark, d).select("entity_id").unionByName(table(spark, d, "train_source2").select("entity_id", "loaded_at"), allowMissingColumns=True)


@query(f"WITH {BUCKET_SQL} SELECT s1, cand FROM bk WHERE e5_rank < 3 UNION SELECT s1, cand FROM bk WHERE addr_key = 1")
def set_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    b = X.buckets(spark, d)
    return b.filter("e5_rank < 3").select("s1", "cand").union(b.filter("addr_key = 1").select("s1", "cand")).distinct()


@query("SELECT entity_id FROM train_source1 EXCEPT SELECT s1_entity_id FROM s1_buckets")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return X.s1(spark, d).select("entity_id").subtract(table(spark, d, "s1_buckets").select("s1_entity_id"))


@query(f"WITH {BUCKET_SQL}, {EDGES_SQL} SELECT s1, cand FROM bk INTERSECT SELECT s1, mid FROM edges")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return X.buckets(spark, d).select("s1", "cand").intersect(X.edges(spark, d))


@query(f"""WITH {BUCKET_SQL} SELECT country, count(*) FILTER (e5_rank IS NULL AND addr_key = 1) AS n, round(count(*) FILTER (e5_rank IS NULL AND addr_key = 1) / count(DISTINCT s1)::DOUBLE, 6) AS per_s1 FROM bk GROUP BY 1""")
def set_newpairs(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if(c("e5_rank").isNull() & (c("addr_key") == 1))
    return X.buckets(spark, d).groupBy("country").agg(n.alias("n"), r6(n / F.count_distinct("s1")).alias("per_s1"))


@query(f"""WITH {BUCKET_SQL}, a AS (SELECT s1, cand FROM bk), b AS (SELECT DISTINCT s1_entity_id, candidate_entity_id FROM s1_buckets), h AS (SELECT s1, cand FROM bk WHERE rank < 5)
SELECT pair, missing, extra, missing + extra = 0 AS equal FROM (SELECT 'same' AS pair, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS extra
UNION ALL SELECT 'head', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM h)), (SELECT count(*) FROM (SELECT * FROM h EXCEPT ALL SELECT * FROM a)))""")
def set_equal(spark: SparkSession, d: str) -> DataFrame:
    a = X.buckets(spark, d).select("s1", "cand")
    b = table(spark, d, "s1_buckets").select(c("s1_entity_id").alias("s1"), c("candidate_entity_id").alias("cand")).distinct()
    return difference(a, b, "same").unionAll(difference(a, X.buckets(spark, d).filter("rank < 5").select("s1", "cand"), "head"))


def difference(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """``(pair, missing, extra, equal)``: rows of ``a`` that ``b`` lacks and the other way round, repeated rows as often as they occur."""
    side = lambda x, missing: x.select(F.lit(missing).alias("m"))
    both = side(a.exceptAll(b), 1).unionAll(side(b.exceptAll(a), 0)).agg(F.count_if(c("m") == 1).alias("missing"), F.count_if(c("m") == 0).alias("extra"))
    return both.select(F.lit(name).alias("pair"), "missing", "extra", (c("missing") + c("extra") == 0).alias("equal"))
