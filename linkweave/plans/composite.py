"""Queries of composed linkage operators: blocking, features, decisions, metrics, validation, sampling, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import similarity as S
from linkweave.functions import text as T
from linkweave.operators import augment, blocking, decide, dense, features, matcher, metrics, profile, sampling, validate
from linkweave.operators import windows as W
from linkweave.plans.registry import query
from linkweave.plans.textual import SOUNDEX_SQL, N, core_sql, keys_sql, list_sql, numkeys_sql, pairs, words_sql
from linkweave.sources import fixtures as X
from linkweave.sources import tsv
from linkweave.sources.fixtures import BUCKET_SQL, EDGES_SQL, P_SQL, POOL_SQL
from linkweave.sources.tables import cut, cut_packed, scratch, table

c = F.col
NATIVE = "[^\\x{0000}-\\x{024F}\\x{1E00}-\\x{1EFF}\\x{2000}-\\x{206F}\\x{20A0}-\\x{20CF}]"


def truth(spark: SparkSession, d: str) -> DataFrame:
    return X.edges(spark, d).withColumnRenamed("mid", "cand")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The records whose matches are known: (s1)."""
    return table(spark, d, "train_matches").select(c("source1_entity_id").alias("s1"))


# ---- lexical blocking

ARMS = " UNION ALL ".join(f"SELECT entity_id, country, '{k}:' || {k} AS k, {p} AS prio FROM keys WHERE {k} IS NOT NULL" for k, p in blocking.PRIORITY.items() if k != "tok")
LONG = f"{ARMS} UNION ALL SELECT entity_id, country, 'tok:' || t, 2 FROM (SELECT entity_id, country, unnest(string_split(name_clean, ' ')) AS t FROM keys) WHERE length(t) >= 4"
LEX = f"""a AS (WITH {keys_sql('train_source1')} {LONG}), b AS (WITH {POOL_SQL}, {keys_sql('pool')} {LONG}), stop AS (SELECT country, k FROM b GROUP BY 1, 2 HAVING count(*) > 2000),
pr AS (SELECT a.entity_id AS s1, b.entity_id AS cand, count(*) AS nkeys, min(a.prio)::INT AS best_prio FROM a JOIN b USING (country, k) WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.country = a.country AND s.k = a.k) GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY nkeys DESC, best_prio, cand) AS n FROM pr) WHERE n <= 30)"""


@query(f"WITH {LEX} SELECT s1, cand, nkeys, best_prio FROM pr")
def agg_pairkeys(spark: SparkSession, d: str) -> DataFrame:
    return blocking.lexical_pairs(X.s1(spark, d), X.pool(spark, d))


@query(f"WITH {LEX} SELECT s1, cand, nkeys, best_prio FROM top")
def blk_lex(spark: SparkSession, d: str) -> DataFrame:
    return blocking.lexical_block(X.s1(spark, d), X.pool(spark, d), 30)


@query(f"WITH {LEX} SELECT s.entity_id AS s1, coalesce(string_agg(cand, ',' ORDER BY nkeys DESC, cand), '') AS ids FROM train_source1 s LEFT JOIN top ON top.s1 = s.entity_id GROUP BY 1")
def blk_lex_lists(spark: SparkSession, d: str) -> DataFrame:
    top = blocking.lexical_block(X.s1(spark, d), X.pool(spark, d), 30).withColumn("p", c("nkeys"))
    lists = decide.ordered_lists(top)
    return X.s1(spark, d).select(c("entity_id").alias("s1")).join(lists, "s1", "left").select("s1", F.coalesce("ids", F.lit("")).alias("ids"))


@query(f"""WITH {POOL_SQL}, k AS (SELECT entity_id AS s1, country, lower(business_name) AS n FROM test_source1), o AS (SELECT entity_id AS cand, country, lower(business_name) AS n FROM pool)
SELECT s1, cand FROM k JOIN o USING (country, n) UNION ALL SELECT s1, cand FROM k JOIN o USING (n) WHERE k.country NOT IN (SELECT country FROM pool)""")
def blk_country(spark: SparkSession, d: str) -> DataFrame:
    k = F.lower(N).alias("n")
    return blocking.by_country(table(spark, d, "test_source1").select("entity_id", "country", k), X.pool(spark, d).select("entity_id", "country", k), "n")


STREET_KEY = f"""(SELECT entity_id, country, CASE WHEN pos IS NOT NULL AND hs <> '' THEN hs || '|' || own[pos][1] END AS key FROM (SELECT *, coalesce(list_filter(flatten(parts[1:pos]), lambda w: regexp_full_match(w, '[0-9]+'))[1], '') AS hs FROM (
SELECT *, list_filter(range(1, len(parts) + 1), lambda i: told[i] AND len(own[i]) > 0)[1] AS pos FROM (SELECT entity_id, country, parts,
list_transform(parts, lambda p: list_filter(p, lambda w: NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({list_sql(T.STREET_TYPES + T.STREET_STOPS)}) AND length(w) > 1)) AS own,
list_transform(parts, lambda p: len(list_filter(p, lambda w: regexp_full_match(w, '[0-9]+') OR w IN ({list_sql(T.STREET_TYPES)}))) > 0) AS told
FROM (SELECT entity_id, country, list_transform(string_split(coalesce(business_address, ''), ','), lambda p: {words_sql('p')}) AS parts FROM {{0}})))))"""


def street_sql(source: str) -> str:
    return STREET_KEY.replace("{0}", source)


def street_key(df: DataFrame) -> DataFrame:
    x = df.select("entity_id", "country", T.street_of("business_address").alias("s"))
    key = F.when((c("s.house") != "") & (c("s.street") != ""), F.concat("s.house", F.lit("|"), F.split("s.street", " ")[0]))
    return x.select("entity_id", "country", key.alias("key"))


ADDRESS = f"""sa AS {street_sql('train_source1')}, sb AS {street_sql('pool')}, so AS (SELECT country, key FROM sb WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) <= 20),
address AS (SELECT sa.entity_id AS s1, sb.entity_id AS cand FROM sa JOIN so USING (country, key) JOIN sb USING (country, key))"""


def address_search(spark: SparkSession, d: str) -> DataFrame:
    return blocking.capped_join(street_key(X.s1(spark, d)), street_key(X.pool(spark, d)), ["country", "key"], 20)


@query(f"WITH {POOL_SQL}, {ADDRESS} SELECT s1, cand FROM address")
def blk_address(spark: SparkSession, d: str) -> DataFrame:
    return address_search(spark, d)


def number_search(spark: SparkSession, d: str) -> DataFrame:
    keys = lambda t: t.filter("country = 'India'").select("entity_id", F.explode(T.number_keys("business_address")).alias("key"))
    return blocking.capped_join(keys(X.s1(spark, d)), keys(X.pool(spark, d)), ["key"], 10).distinct()


NUMBER = f"""na AS (WITH {numkeys_sql('train_source1')} SELECT * FROM numkeys WHERE country = 'India'), nb AS (WITH {numkeys_sql('pool')} SELECT * FROM numkeys WHERE country = 'India'),
nok AS (SELECT key FROM nb GROUP BY 1 HAVING count(*) <= 10), number AS (SELECT DISTINCT na.entity_id AS s1, nb.entity_id AS cand FROM na JOIN nok USING (key) JOIN nb USING (key))"""


@query(f"WITH {POOL_SQL}, {NUMBER} SELECT s1, cand FROM number")
def blk_number(spark: SparkSession, d: str) -> DataFrame:
    return number_search(spark, d)


def tfidf_sql(a: str, b: str, ga: str = "ga", gb: str = "gb") -> str:
    """Unit 3-gram vectors of the texts of two relations (entity_id, country, t), each country with its own vocabulary."""
    gram = "SELECT entity_id, country, gram, 1 + ln(count(*)) AS tf FROM (SELECT entity_id, country, substr(w, i, 3) AS gram FROM (SELECT entity_id, country, w, unnest(range(1, greatest(1, length(w) - 2) + 1)) AS i FROM (SELECT entity_id, country, ' ' || w || ' ' AS w FROM (SELECT entity_id, country, unnest(regexp_split_to_array(lower(t), '\\s+')) AS w FROM {0}) WHERE w <> ''))) GROUP BY ALL"
    return f"""t{ga} AS ({gram.replace('{0}', a)}), t{gb} AS ({gram.replace('{0}', b)}), n{ga} AS (SELECT country, count(*) AS n FROM (SELECT country FROM {a} UNION ALL SELECT country FROM {b}) GROUP BY 1),
v{ga} AS (SELECT country, gram, ln((1 + n) / (1.0 + count(*))) + 1 AS idf FROM (SELECT country, gram FROM t{ga} UNION ALL SELECT country, gram FROM t{gb}) JOIN n{ga} USING (country) GROUP BY country, gram, n HAVING count(*) >= 2 AND count(*) <= 0.02 * n),
w{ga} AS (SELECT entity_id, country, gram, tf * idf AS w FROM t{ga} JOIN v{ga} USING (country, gram)), w{gb} AS (SELECT entity_id, country, gram, tf * idf AS w FROM t{gb} JOIN v{ga} USING (country, gram)),
{ga} AS (SELECT entity_id, country, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM w{ga}), {gb} AS (SELECT entity_id, country, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM w{gb})"""


def top_sql(k: int, a: str = "ga", b: str = "gb") -> str:
    return f"(SELECT s1, cand, sim, (r - 1)::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY sim DESC, cand) AS r FROM (SELECT x.entity_id AS s1, y.entity_id AS cand, round(sum(x.w * y.w), 6) AS sim FROM {a} x JOIN {b} y USING (country, gram) GROUP BY 1, 2)) WHERE r <= {k})"


NAMED = "ia AS (SELECT entity_id, country, business_name AS t FROM train_source1), ib AS (SELECT entity_id, country, business_name AS t FROM pool)"


def names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # The pool is made distinct once; what is kept are ids and names.
    t = lambda x: x.select("entity_id", "country", c(N).alias("t"))
    return t(X.s1(spark, d)), cut_packed(t(X.pool(spark, d)))


@query(f"WITH {POOL_SQL}, {NAMED}, {tfidf_sql('ia', 'ib')} SELECT entity_id, gram, round(w, 5) AS w FROM ga UNION ALL SELECT entity_id, gram, round(w, 5) FROM gb")
def sim_tfidf(spark: SparkSession, d: str) -> DataFrame:
    a, b = blocking.tfidf(*names(spark, d), "t")
    return a.unionByName(b).select("entity_id", "gram", F.round("w", 5).alias("w"))


@query(f"WITH {POOL_SQL}, {NAMED}, {tfidf_sql('ia', 'ib')} SELECT s1, cand, sim, r FROM {top_sql(5)}")
def blk_name3g(spark: SparkSession, d: str) -> DataFrame:
    return blocking.text_top(*names(spark, d), "t", 5)


@query(f"WITH {POOL_SQL}, {NAMED}, {tfidf_sql('ia', 'ib')} SELECT s1 AS cand, cand AS s1, sim, r FROM {top_sql(10, 'gb', 'ga')}")
def jn_sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    a, b = names(spark, d)
    return blocking.text_top(b, a, "t", 10).select(c("s1").alias("cand"), c("cand").alias("s1"), "sim", "r")


EMPTY = "ea AS (SELECT entity_id, country, business_name AS t FROM train_source1), eb AS (SELECT entity_id, country, business_name AS t FROM pool WHERE trim(coalesce(business_address, '')) IN ('', '-', 'N/A'))"


def empty_searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Name search among the records without an address: the two best of each clean record, the three best clean records of each."""
    a = X.s1(spark, d).select("entity_id", "country", c(N).alias("t"))
    b = cut_packed(X.pool(spark, d).filter(F.trim(T.text("business_address")).isin("", "-", "N/A")).select("entity_id", "country", c(N).alias("t")))
    back = blocking.text_top(b, a, "t", 3).select(c("cand").alias("s1"), c("s1").alias("cand"), "sim", "r")
    return blocking.text_top(a, b, "t", 2), back


@query(f"WITH {POOL_SQL}, {EMPTY}, {tfidf_sql('ea', 'eb')} SELECT 's1' AS side, s1, cand, sim, r FROM {top_sql(2)} UNION ALL SELECT 'cand', cand, s1, sim, r FROM {top_sql(3, 'gb', 'ga')}")
def blk_empty(spark: SparkSession, d: str) -> DataFrame:
    out, back = empty_searches(spark, d)
    side = lambda s, name: s.select(F.lit(name).alias("side"), "s1", "cand", "sim", "r")
    return side(out, "s1").unionByName(side(back, "cand"))


WORD_SCORE = "len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::DOUBLE"


@query(f"""WITH {POOL_SQL}, {ADDRESS}, {NUMBER}, {NAMED}, {tfidf_sql('ia', 'ib')}, {EMPTY}, {tfidf_sql('ea', 'eb', 'ha', 'hb')},
al AS (SELECT s1, cand, 'address' AS k, 0 AS r FROM address UNION ALL SELECT s1, cand, 'number', 0 FROM number UNION ALL SELECT s1, cand, 'name', r FROM {top_sql(5)} UNION ALL SELECT s1, cand, 'empty', r FROM {top_sql(2, 'ha', 'hb')} UNION ALL SELECT cand, s1, 'empty_back', r FROM {top_sql(3, 'hb', 'ha')}),
un AS (SELECT s1, cand, min(r) FILTER (k = 'name') AS name_rank, min(r) FILTER (k = 'empty') AS empty_rank, min(r) FILTER (k = 'empty_back') AS empty_back_rank, max((k = 'address')::INT) AS address_key, max((k = 'number')::INT) AS number_key FROM al GROUP BY 1, 2),
wx AS (SELECT entity_id, list_distinct(string_split(lower(business_name), ' ')) AS w FROM train_source1), wy AS (SELECT entity_id, list_distinct(string_split(lower(business_name), ' ')) AS w FROM pool),
sc AS (SELECT un.*, round({WORD_SCORE}, 6) AS score FROM un JOIN wx x ON x.entity_id = s1 JOIN wy y ON y.entity_id = cand)
SELECT s1, cand, score, (row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) - 1)::INT AS rank, name_rank::INT AS name_rank, empty_rank::INT AS empty_rank, empty_back_rank::INT AS empty_back_rank, address_key, number_key FROM sc""")
def blk_union(spark: SparkSession, d: str) -> DataFrame:
    """The searches over texts in one list, scored by shared words of the names."""
    u = with_keys(blocking.union_searches(text_searches(spark, d, blk_name3g(spark, d))))
    told = lambda t, k: t.select(c("entity_id").alias(k), F.array_distinct(F.split(F.lower(N), " ")).alias(f"v_{k}"))
    scored = u.join(told(X.s1(spark, d), "s1"), "s1").join(told(X.pool(spark, d), "cand"), "cand").withColumn("score", F.round(S.jaccard(c("v_s1"), c("v_cand")), 6))
    return by_score(scored.drop("v_s1", "v_cand"))


@query()
def blk_union_dense(spark: SparkSession, d: str) -> DataFrame:
    """All seven searches in one list: those over texts, and forward and backward search of centered vectors, whose cosine scores every pair."""
    a, b = names(spark, d)
    x, y = (t.select("entity_id", "country", F.coalesce("t", F.lit("")).alias("text")) for t in (a, b))
    mean = dense.text_means(y)
    back = dense.text_dense_top(y, x, 2, mean).select(c("cand").alias("s1"), c("s1").alias("cand"), "score", "r")
    found = {"dense": dense.text_dense_top(x, y, 30, mean), "reverse": back}
    texts = text_searches(spark, d, blocking.text_top(a, b, "t", 5))
    told = lambda t, k: t.select(c("entity_id").alias(k), c("text").alias(f"text_{k}"))
    rows = blocking.union_searches(texts).join(told(x, "s1"), "s1").join(told(y, "cand"), "cand").withColumn("score", dense.text_cosine("text_s1", "text_cand")).drop("text_s1", "text_cand")
    for name, s in found.items():
        rows = rows.unionByName(s.select("s1", "cand", "score", c("r").alias(f"{name}_rank")), allowMissingColumns=True)
    # Pairs go over the network once, by record, for the union and for the ranks.
    ranks = [F.min(f"{k}_rank").alias(f"{k}_rank") for k in (*found, *texts)]
    u = with_keys(rows.repartition("s1").groupBy("s1", "cand").agg(*ranks, F.max("score").alias("of"))).withColumn("score", F.round("of", 6))
    return by_score(u.select("cand", "s1", *[n for n in u.columns if n not in ("s1", "cand", "of")]))


def text_searches(spark: SparkSession, d: str, name: DataFrame) -> dict[str, DataFrame]:
    """The five searches over texts; ``name`` is that of all names."""
    empty, back = empty_searches(spark, d)
    flag = lambda s: s.withColumn("r", F.lit(0))
    return {"name": name, "empty": empty, "empty_back": back, "address": flag(address_search(spark, d)), "number": flag(number_search(spark, d))}


def with_keys(u: DataFrame) -> DataFrame:
    """Searches by key have no rank: 1 where they found the pair, else 0."""
    keys = {f"{k}_key": F.coalesce(1 - c(f"{k}_rank"), F.lit(0)) for k in ("address", "number")}
    return u.withColumns(keys).drop("address_rank", "number_rank")


def by_score(scored: DataFrame) -> DataFrame:
    return W.ranked(scored, "s1", [c("score").desc_nulls_last(), c("cand")]).withColumnRenamed("r", "rank")


@query(f"""WITH {POOL_SQL}, {EDGES_SQL}, ka AS (WITH {core_sql('train_source1')}, {SOUNDEX_SQL} SELECT entity_id AS s1, country || '|' || code || '|' || left(core, 4) AS key FROM sx),
kb AS (WITH {core_sql('pool')}, {SOUNDEX_SQL} SELECT entity_id AS cand, country || '|' || code || '|' || left(core, 4) AS key FROM sx), ok AS (SELECT key FROM kb GROUP BY 1 HAVING count(*) <= 2000),
hit AS (SELECT DISTINCT s1, cand FROM ka JOIN ok USING (key) JOIN kb USING (key)), t AS (SELECT e.s1, e.mid, CASE WHEN regexp_matches(p.business_name, '{NATIVE}') THEN 'native' ELSE 'latin' END AS slice FROM edges e JOIN pool p ON p.entity_id = e.mid)
SELECT slice, count(*) AS pairs, count(cand) AS found, round(count(cand) / count(*)::DOUBLE, 6) AS recall FROM t LEFT JOIN hit ON hit.s1 = t.s1 AND cand = mid GROUP BY 1""")
def blk_phonkey(spark: SparkSession, d: str) -> DataFrame:
    """Recall of blocking by country, sound and first letters of the core name, by the script of the match."""
    key = T.block_key(N).alias("key")
    found = blocking.capped_join(X.s1(spark, d).select("entity_id", key), X.pool(spark, d).select("entity_id", key), ["key"], 2000)
    script = X.pool(spark, d).select(c("entity_id").alias("cand"), F.when(T.is_native(N), "native").otherwise("latin").alias("slice"))
    return metrics.recall(found, truth(spark, d).join(script, "cand"), "slice")


# ---- dense search: every vector asks, all others answer


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.select(c("vec_id").alias("q"), c("embedding").alias("v")), e.select(c("vec_id").alias("c"), c("embedding").alias("v"))


DENSE = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT a.vec_id AS q, b.vec_id AS c, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id),
rk AS (SELECT q, c, sim, (row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) - 1)::INT AS r FROM s)"""


@query(f"WITH {DENSE} SELECT q, c, sim, r FROM rk WHERE r < 10")
def jn_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_top(*vectors(spark, d), 10, not_self=True)


@query(f"WITH {DENSE} SELECT q, c, sim FROM rk WHERE r < 3")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_top(*vectors(spark, d), 3, not_self=True).select("q", "c", "sim")


CENTERED = """e AS (SELECT entity_id, country, s1_embeddings::DOUBLE[] AS v FROM s1_embeddings WHERE s1_embeddings IS NOT NULL),
m AS (SELECT country, list(a ORDER BY i) AS mean FROM (SELECT country, i, avg(x) AS a FROM (SELECT country, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY 1, 2) GROUP BY 1),
cv AS (SELECT entity_id, country, list_transform(list_zip(v, mean), lambda z: z[1] - z[2]) AS v FROM e JOIN m USING (country)),
s AS (SELECT a.entity_id AS s1, b.entity_id AS cand, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM cv a JOIN cv b ON a.country = b.country AND a.entity_id <> b.entity_id)"""


def record_vectors(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k nearest of each record's vector within its country, centered on the country's mean."""
    e = table(spark, d, "s1_embeddings").select("entity_id", "country", c("s1_embeddings").alias("v"))
    mean = dense.mean_vectors(e, "v", "country")
    return dense.dense_top(e.withColumnRenamed("entity_id", "q"), e.withColumnRenamed("entity_id", "c"), k, mean, "country", not_self=True)


@query(f"WITH {CENTERED} SELECT s1, cand, sim, r FROM (SELECT *, (row_number() OVER (PARTITION BY s1 ORDER BY sim DESC, cand) - 1)::INT AS r FROM s) WHERE r < 30")
def blk_dense(spark: SparkSession, d: str) -> DataFrame:
    return record_vectors(spark, d, 30).select(c("q").alias("s1"), c("c").alias("cand"), "sim", "r")


@query(f"WITH {CENTERED} SELECT s1, cand, sim, r, r < 2 AS adds FROM (SELECT *, (row_number() OVER (PARTITION BY cand ORDER BY sim DESC, s1) - 1)::INT AS r FROM s) WHERE r < 5")
def blk_reverse(spark: SparkSession, d: str) -> DataFrame:
    return record_vectors(spark, d, 5).select(c("c").alias("s1"), c("q").alias("cand"), "sim", "r", (c("r") < 2).alias("adds"))


@query("""WITH m AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(x) AS a FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1)),
cv AS (SELECT vec_id, list_transform(list_zip(embedding::DOUBLE[], mean), lambda z: z[1] - z[2]) AS v FROM embeddings, m), u AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) / greatest(sqrt(list_inner_product(v, v)), 1e-12) AS x FROM cv) SELECT vec_id, i::INT AS i, round(x, 6) AS x FROM u""")
def sim_centered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    mean = F.array(*[F.lit(x) for x in dense.mean_vector(e, "embedding")])
    return e.select("vec_id", F.posexplode(S.centered(c("embedding"), mean)).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query()
def jn_ivfpq(spark: SparkSession, d: str) -> DataFrame:
    """Approximate neighbours of the records' vectors, those with an id divisible by 100 asking and all answering."""
    e = table(spark, d, "s1_embeddings").select("vec_id", c("s1_embeddings").alias("v"))
    return dense.ivf_top(e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "q"), e.withColumnRenamed("vec_id", "c"), 11).filter("q <> c").select("q", "c", "sim")


@query()
def emb_encode(spark: SparkSession, d: str) -> DataFrame:
    return dense.encode(X.s1(spark, d), "entity_id", N)


@query()
def jn_fuzzy_best(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).select("s1", "mid", F.explode("tx").alias("w"), "ty").select("s1", "mid", "w", F.explode("ty").alias("v"))
    best = p.withColumn("sim", S.ratio_col("w", "v")).filter("sim >= 55").groupBy("s1", "mid", "w")
    return best.agg(F.max_by("v", F.struct("sim", "v")).alias("best"), F.max("sim").alias("sim"))


# ---- labels, features, model


@query(f"WITH {BUCKET_SQL}, {EDGES_SQL} SELECT bk.s1, cand, (e.mid IS NOT NULL)::INT AS is_true FROM bk JOIN train_matches m ON m.source1_entity_id = bk.s1 LEFT JOIN edges e ON e.s1 = bk.s1 AND e.mid = cand")
def mat_label(spark: SparkSession, d: str) -> DataFrame:
    return labelled_pairs(spark, d).select("s1", "cand", "is_true")


def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = X.buckets(spark, d).join(labelled(spark, d), "s1", "left_semi")
    return b.join(truth(spark, d).withColumn("_t", F.lit(1)), ["s1", "cand"], "left").withColumn("is_true", F.coalesce("_t", F.lit(0))).drop("_t")


@query()
def mat_features(spark: SparkSession, d: str) -> DataFrame:
    return features.pair_features(X.buckets(spark, d), X.s1(spark, d), X.pool(spark, d))


@query()
def mat_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.folds(labelled_pairs(spark, d).select("s1", "cand"), "s1", 5)


@query()
def mat_sample_s1(spark: SparkSession, d: str) -> DataFrame:
    return sampling.per_group(X.s1(spark, d), "country", "entity_id", 50)


@query()
def mat_negdown(spark: SparkSession, d: str) -> DataFrame:
    return sampling.negatives_down(labelled_pairs(spark, d).select("s1", "cand", "is_true"), "is_true", ["s1", "cand"])


def labelled_features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The 85 features of every pair of the records whose matches are known, with ``is_true``, written once for the fits."""
    f = features.pair_features(X.buckets(spark, d), X.s1(spark, d), X.pool(spark, d), labelled(spark, d))
    rows = f.join(truth(spark, d).withColumn("_t", F.lit(1)), ["s1", "cand"], "left").withColumn("is_true", F.coalesce("_t", F.lit(0))).drop("_t")
    return cut(rows), features.feature_set("all")


@query()
def mat_fit(spark: SparkSession, d: str) -> DataFrame:
    p, columns = labelled_features(spark, d)
    return matcher.predict(matcher.fit(p, columns), p, columns).select("s1", "cand", "is_true", F.round("p", 6).alias("p"))


@query()
def mat_oof(spark: SparkSession, d: str) -> DataFrame:
    return matcher.out_of_fold(*labelled_features(spark, d)).select("s1", "cand", "is_true", "fold", F.round("p", 6).alias("p"))


@query()
def mat_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each country scored by a model of the other."""
    p, columns = labelled_features(spark, d)
    parts = [matcher.transfer(p, columns, country) for country in ("India", "US")]
    return parts[0].unionByName(parts[1]).select("s1", "cand", "country", "is_true", F.round("p", 6).alias("p"))


@query()
def mat_importance(spark: SparkSession, d: str) -> DataFrame:
    p, columns = labelled_features(spark, d)
    return spark.createDataFrame(matcher.importance(matcher.fit(p, columns), columns), "feature string, gain double, splits int")


@query("SELECT 'all' AS name, 85 AS n UNION ALL SELECT 'submission2', 61 UNION ALL SELECT 'base', 44")
def mat_featureset(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, len(set(features.feature_set(k)))) for k in ("all", "submission2", "base")], "name string, n int")


# ---- decisions

OWN = f"{P_SQL}, own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS n FROM pr) WHERE n = 1)"


@query(f"WITH {P_SQL} SELECT s1, cand, p FROM pr WHERE p >= CASE country WHEN 'India' THEN 0.7 ELSE 0.6 END")
def dec_thresh(spark: SparkSession, d: str) -> DataFrame:
    return decide.cutoff(X.probabilities(spark, d), 0.6, {"India": 0.7}).select("s1", "cand", "p")


@query(f"WITH {OWN} SELECT s1, cand, p FROM own WHERE p >= 0.6")
def dec_oneowner(spark: SparkSession, d: str) -> DataFrame:
    return decide.cutoff(decide.one_owner(X.probabilities(spark, d)), 0.6).select("s1", "cand", "p")


@query(f"WITH {OWN} SELECT s1, cand FROM own WHERE p >= CASE country WHEN 'India' THEN 0.8 ELSE 0.5 END")
def dec_rethresh(spark: SparkSession, d: str) -> DataFrame:
    return decide.cutoff(decide.one_owner(X.probabilities(spark, d)), 0.5, {"India": 0.8}).select("s1", "cand")


def grid_sql(steps: list[float], by: str = "") -> str:
    values = ", ".join(f"({t!r}::DOUBLE)" for t in steps)
    col, on = (f"{by}, ", f" AND x.{by} = rec.{by}") if by else ("", "")
    return f"""{EDGES_SQL}, {OWN}, grid(t) AS (VALUES {values}), rec AS (SELECT source1_entity_id AS s1, s.country FROM train_matches JOIN train_source1 s ON s.entity_id = source1_entity_id),
tn AS (SELECT s1, count(*) AS n FROM edges GROUP BY 1), hits AS (SELECT own.s1, p, (e.mid IS NOT NULL)::INT AS hit FROM own LEFT JOIN edges e ON e.s1 = own.s1 AND e.mid = cand),
att AS (SELECT t, rec.s1, {'rec.' + col if col else ''}count(p) AS n, coalesce(sum(hit), 0) AS tp, coalesce(any_value(tn.n), 0) AS true_n FROM grid CROSS JOIN rec LEFT JOIN hits ON hits.s1 = rec.s1 AND p >= t LEFT JOIN tn ON tn.s1 = rec.s1 GROUP BY ALL),
cv AS (SELECT t, {col}round(avg(CASE WHEN true_n = 0 THEN (n = 0)::INT::DOUBLE WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (0.25 * true_n + n) END), 6) AS score FROM att GROUP BY ALL)"""


GRID = [round(0.01 * i, 2) for i in range(2, 99)]
COSINE_GRID = [round(0.8 + 0.005 * i, 3) for i in range(39)]
LEX_GRID = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(f"WITH {grid_sql(GRID)} SELECT t, score FROM cv")
def dec_curve(spark: SparkSession, d: str) -> DataFrame:
    return decide.curve(decide.one_owner(X.probabilities(spark, d)), truth(spark, d), labelled(spark, d), GRID)


@query(f"WITH {grid_sql(GRID)} SELECT t, score FROM cv ORDER BY score DESC, t LIMIT 1")
def dec_tune(spark: SparkSession, d: str) -> DataFrame:
    return decide.tune(decide.one_owner(X.probabilities(spark, d)), truth(spark, d), labelled(spark, d), GRID)


COSINE_OWN = f"{BUCKET_SQL}, pr AS (SELECT s1, cand, round(cosine, 4) AS p FROM bk WHERE cosine IS NOT NULL), own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS n FROM pr) WHERE n = 1)"


@query(f"WITH {grid_sql(COSINE_GRID).replace(OWN, COSINE_OWN)} SELECT t, score FROM cv ORDER BY score DESC, t LIMIT 1")
def dec_tune_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = X.buckets(spark, d).filter("cosine IS NOT NULL").select("s1", "cand", F.round("cosine", 4).alias("p"))
    return decide.tune(decide.one_owner(p), truth(spark, d), labelled(spark, d), COSINE_GRID)


@query(f"WITH {grid_sql(LEX_GRID, 'country')} SELECT country, t, score FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY score DESC, t) AS n FROM cv) WHERE n = 1")
def dec_tune_lex(spark: SparkSession, d: str) -> DataFrame:
    rec = labelled(spark, d).join(X.s1(spark, d).select(c("entity_id").alias("s1"), "country"), "s1")
    return decide.tune(decide.one_owner(X.probabilities(spark, d)), truth(spark, d), rec, LEX_GRID, "country").select("country", "t", "score")


@query(f"""WITH {OWN}, m AS (SELECT s1, string_agg(cand, ',' ORDER BY p DESC, cand) AS matches FROM own WHERE p >= 0.6 GROUP BY 1), k AS (SELECT s1, string_agg(cand, ',' ORDER BY p DESC, cand) AS candidates FROM pr GROUP BY 1)
SELECT entity_id AS s1, coalesce(matches, '') AS matches, coalesce(candidates, '') AS candidates FROM train_source1 LEFT JOIN m ON m.s1 = entity_id LEFT JOIN k ON k.s1 = entity_id""")
def dec_submit(spark: SparkSession, d: str) -> DataFrame:
    p = X.probabilities(spark, d)
    return decide.submission(X.s1(spark, d), decide.one_owner(p).filter("p >= 0.6"), p)


# ---- metrics

SCORES = f"""{EDGES_SQL}, {OWN}, rec AS (SELECT source1_entity_id AS s1 FROM train_matches), pd AS (SELECT s1, cand FROM own WHERE p >= 0.6),
sc AS (SELECT rec.s1, (SELECT count(*) FROM pd WHERE pd.s1 = rec.s1) AS n, (SELECT count(*) FROM edges e WHERE e.s1 = rec.s1) AS true_n, (SELECT count(*) FROM pd JOIN edges e ON e.s1 = pd.s1 AND e.mid = pd.cand WHERE pd.s1 = rec.s1) AS tp FROM rec),
fs AS (SELECT *, CASE WHEN true_n = 0 THEN (n = 0)::INT::DOUBLE WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * true_n + n) END AS f FROM sc)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    predicted = decide.one_owner(X.probabilities(spark, d)).filter("p >= 0.6")
    return metrics.f_half(labelled(spark, d), predicted, truth(spark, d))


@query(f"WITH {SCORES} SELECT s1, n, true_n, tp, round(f, 6) AS f FROM fs")
def met_f05(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).withColumn("f", F.round("f", 6))


@query(f"WITH {SCORES} SELECT round(avg(f), 6) AS score, round(avg(f) FILTER (true_n > 0), 6) AS matched, round(avg(f) FILTER (true_n = 0), 6) AS singletons FROM fs")
def met_macro(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro(scores(spark, d))


@query(f"""WITH {BUCKET_SQL}, {EDGES_SQL}, {POOL_SQL}, t0 AS (SELECT e.s1, e.mid, trim(coalesce(p.business_address, '')) = '' AS empty, regexp_matches(p.business_name, '{NATIVE}') AS native FROM edges e JOIN pool p ON p.entity_id = e.mid),
t AS (SELECT s1, mid, unnest(list_filter(['all', CASE WHEN native THEN 'native' ELSE 'latin' END, CASE WHEN empty THEN 'empty_address' END], lambda x: x IS NOT NULL)) AS slice FROM t0), v AS (SELECT round(count(*) / count(DISTINCT s1)::DOUBLE, 6) AS per_s1 FROM bk)
SELECT slice, count(*) AS pairs, count(cand) AS found, round(count(cand) / count(*)::DOUBLE, 6) AS recall, any_value(per_s1) AS per_s1 FROM t CROSS JOIN v LEFT JOIN bk ON bk.s1 = t.s1 AND cand = mid GROUP BY 1""")
def met_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the buckets over all true pairs and by slice, beside the pairs a record."""
    names = F.array(F.lit("all"), F.when(T.is_native(N), "native").otherwise("latin"), F.when(F.trim(T.text("business_address")) == "", "empty_address"))
    slices = X.pool(spark, d).select(c("entity_id").alias("cand"), F.explode(F.array_compact(names)).alias("slice"))
    b = X.buckets(spark, d)
    per = b.agg(F.round(F.count("*") / F.count_distinct("s1"), 6).alias("per_s1"))
    return metrics.recall(b, truth(spark, d).join(slices, "cand"), "slice").withColumn("per_s1", per.scalar())


@query(f"""WITH {BUCKET_SQL}, {EDGES_SQL}, r AS (SELECT m.source1_entity_id AS s1, count(mid) AS n, count(cand) AS k FROM train_matches m LEFT JOIN edges e ON e.s1 = m.source1_entity_id LEFT JOIN bk ON bk.s1 = e.s1 AND cand = mid GROUP BY 1)
SELECT round(avg(CASE WHEN n = 0 THEN 1.0 WHEN k = 0 THEN 0.0 ELSE 1.25 * (k / n::DOUBLE) / (0.25 + k / n::DOUBLE) END), 6) AS ceiling FROM r""")
def met_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ceiling(labelled(spark, d), X.buckets(spark, d), truth(spark, d))


RANKED = f"{BUCKET_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC NULLS LAST, cand) - 1 AS r FROM bk)"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return W.ranked(X.buckets(spark, d), "s1", [c("score").desc_nulls_last(), c("cand")])


@query(f"""WITH {RANKED}, {EDGES_SQL}, x AS (SELECT k, e.s1, avg((coalesce(r, 1000000) < k)::INT) AS a, sum((coalesce(r, 1000000) < k)::INT) AS s, count(*) AS n FROM edges e CROSS JOIN (VALUES (1), (5), (10), (20), (50)) g(k) LEFT JOIN rk ON rk.s1 = e.s1 AND cand = mid GROUP BY 1, 2)
SELECT k, round(avg(a), 6) AS per_record, round(sum(s) / sum(n)::DOUBLE, 6) AS pooled FROM x GROUP BY 1""")
def met_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recall_at(ranked(spark, d), truth(spark, d), [1, 5, 10, 20, 50])


@query(f"""WITH {RANKED}, {EDGES_SQL}, pd AS (SELECT 'top5' AS rule, s1, cand FROM rk WHERE r < 5 UNION ALL SELECT 'cosine', s1, cand FROM rk WHERE cosine >= 0.9 UNION ALL SELECT 'ceiling', rk.s1, cand FROM rk JOIN edges e ON e.s1 = rk.s1 AND e.mid = cand),
ru(rule) AS (VALUES ('nothing'), ('top5'), ('cosine'), ('ceiling')), sc AS (SELECT rule, source1_entity_id AS s1, (SELECT count(*) FROM pd WHERE pd.rule = ru.rule AND pd.s1 = source1_entity_id) AS n, (SELECT count(*) FROM edges e WHERE e.s1 = source1_entity_id) AS true_n,
(SELECT count(*) FROM pd JOIN edges e ON e.s1 = pd.s1 AND e.mid = pd.cand WHERE pd.rule = ru.rule AND pd.s1 = source1_entity_id) AS tp FROM ru CROSS JOIN train_matches)
SELECT rule, round(avg(CASE WHEN true_n = 0 THEN (n = 0)::INT::DOUBLE WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * true_n + n) END), 6) AS score FROM sc GROUP BY 1""")
def met_baselines(spark: SparkSession, d: str) -> DataFrame:
    return metrics.baselines(labelled(spark, d), ranked(spark, d).select("s1", "cand", "r", "cosine"), truth(spark, d), 5, 0.9)


PLANTED = ["S1-x\tS1-1,S9-2,S9-2,S2-x", "no tab here", "source1_entity_id\tmatched_entity_ids"]
SHOW = "(SELECT coalesce(string_agg(x, ' | ' ORDER BY x), '') FROM (SELECT DISTINCT x FROM {0} ORDER BY x LIMIT 3))"
RULES = {"no_tab": "nt", "repeated_row": "rr", "repeated_id": "ri", "own_id": "oi", "wrong_prefix": "wp", "unknown_id": "ui", "missing": "mi", "extra": "ex", "outside": "ou"}


@query(f"""WITH {POOL_SQL}, {BUCKET_SQL}, li AS (SELECT source1_entity_id AS s1, matched_entity_ids AS ids FROM train_matches UNION ALL SELECT 'S1-x', 'S1-1,S9-2,S9-2,S2-x'), it AS (SELECT DISTINCT s1, unnest(string_split(ids, ',')) AS id FROM li WHERE ids <> ''),
nt AS (SELECT 'no tab here' AS x), rr AS (SELECT s1 AS x FROM li GROUP BY 1 HAVING count(*) > 1), ri AS (SELECT s1 AS x FROM li WHERE len(list_distinct(string_split(ids, ','))) < len(string_split(ids, ','))), oi AS (SELECT DISTINCT id AS x FROM it WHERE id LIKE 'S1-%'),
wp AS (SELECT DISTINCT id AS x FROM it WHERE NOT regexp_matches(id, '^S[123]-')), ui AS (SELECT DISTINCT id AS x FROM it WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM pool)), mi AS (SELECT entity_id AS x FROM train_source1 WHERE entity_id NOT IN (SELECT s1 FROM li)),
ex AS (SELECT DISTINCT s1 AS x FROM li WHERE s1 NOT IN (SELECT entity_id FROM train_source1)), ou AS (SELECT DISTINCT it.s1 || ' ' || id AS x FROM it LEFT JOIN bk ON bk.s1 = it.s1 AND bk.cand = id WHERE bk.s1 IS NULL)
SELECT 'header' AS rule, 1 AS n, '' AS examples UNION ALL {' UNION ALL '.join(f"SELECT '{k}', (SELECT count(*) FROM {v}), {SHOW.replace('{0}', v)}" for k, v in RULES.items())}""")
def val_format(spark: SparkSession, d: str) -> DataFrame:
    """A results file with a few planted breaches, written and checked."""
    path = scratch(spark, "results")
    tsv.write_tsv(table(spark, d, "train_matches").select("source1_entity_id", "matched_entity_ids"), path)
    spark.createDataFrame([(x,) for x in PLANTED], "value string").write.mode("append").text(path)
    return validate.check(spark.read.text(path), "source1_entity_id\tmatched_entity_ids", X.s1(spark, d), X.pool(spark, d), X.buckets(spark, d))


# ---- samples, profile, noise


@query()
def smp_stratified(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(X.s1(spark, d).withColumn("state", F.regexp_extract("business_address", "([A-Za-z ]+) [0-9]+$", 1)), "state", "entity_id", 300)


@query()
def smp_linked(spark: SparkSession, d: str) -> DataFrame:
    return sampling.linked(X.s1(spark, d), X.pool(spark, d), X.edges(spark, d), 0.2)


@query()
def smp_anchored(spark: SparkSession, d: str) -> DataFrame:
    known = X.s1(spark, d).join(labelled(spark, d).withColumnRenamed("s1", "entity_id"), "entity_id", "left_semi")
    return sampling.linked(known, X.pool(spark, d), X.edges(spark, d), 0.5, 7)


def tags() -> dict[str, F.Column]:
    """The eight tags of a processed record that a sample must hold."""
    return {
        "native": T.is_native(N), "web": (c("domain_stem") != "") | T.is_handle(N), "empty": c("empty_addr") == 1, "honorific": c("has_honorific") == 1, "landmark": c("landmark_flag") == 1,
        "postcode": c("missing_pin") == 0, "no_legal": c("legal_form") == "", "one_word": F.size(F.split(c("core_name"), " ")) <= 1,
    }


@query()
def smp_tagmin(spark: SparkSession, d: str) -> DataFrame:
    """400 records of the noisy sources, 70 % linked to a known record, with at least a twentieth of each tag."""
    owner = X.edges(spark, d).select(c("mid").alias("entity_id"), F.lit(True).alias("_owned")).distinct()
    p = T.processed(X.pool(spark, d)).join(owner, "entity_id", "left").withColumn("kind", F.when(c("_owned"), "linked").otherwise("no_match"))
    p = cut(p)
    return sampling.linked_share(p, "kind", tags(), "entity_id", 400).select("entity_id", "kind", *[v.alias(k) for k, v in tags().items()])


PRF_SIDE = """SELECT '{0}_rows_' || lower(country) AS fact, count(*)::DOUBLE AS value FROM {1} GROUP BY country UNION ALL SELECT '{0}_rows', count(*) FROM {1} UNION ALL SELECT '{0}_empty_address', count(*) FILTER (trim(coalesce(business_address, '')) = '') FROM {1}
UNION ALL SELECT '{0}_distinct_names', count(DISTINCT business_name) FROM {1} UNION ALL SELECT '{0}_mean_name', round(avg(length(business_name)), 6) FROM {1} UNION ALL SELECT '{0}_mean_address', round(avg(length(business_address)), 6) FROM {1}
UNION ALL SELECT '{0}_longest_name', max(length(business_name)) FROM {1} UNION ALL SELECT '{0}_native_names', count(*) FILTER (regexp_matches(business_name, '""" + NATIVE + """')) FROM {1} UNION ALL SELECT '{0}_exact_copies', count(*) - count(DISTINCT (business_name, coalesce(business_address, ''), country)) FROM {1}"""


def prf_sql(name: str, source: str) -> str:
    return PRF_SIDE.replace("{0}", name).replace("{1}", source)


@query(f"""WITH {POOL_SQL}, {EDGES_SQL}, mc AS (SELECT source1_entity_id AS s1, count(mid) AS n FROM train_matches LEFT JOIN edges ON edges.s1 = source1_entity_id GROUP BY 1)
{prf_sql('s1', 'train_source1')} UNION ALL {prf_sql('pool', 'pool')} UNION ALL SELECT 'links', count(*) FROM edges UNION ALL SELECT 'links_mean', round(avg(n), 6) FROM mc WHERE n > 0 UNION ALL SELECT 'links_most', max(n) FROM mc
UNION ALL SELECT 'singletons_share', round(avg((n = 0)::INT), 6) FROM mc UNION ALL SELECT 'reused_most', max(k) FROM (SELECT count(*) AS k FROM edges GROUP BY mid) UNION ALL SELECT 'unlinked_pool', count(*) FROM pool WHERE entity_id NOT IN (SELECT mid FROM edges)
UNION ALL SELECT 'dangling_links', count(*) FROM edges WHERE mid NOT IN (SELECT entity_id FROM pool)""")
def prf_eda(spark: SparkSession, d: str) -> DataFrame:
    """The profile of both sides and of the links in one list of facts."""
    return profile.report({"s1": X.s1(spark, d), "pool": X.pool(spark, d)}, labelled(spark, d), X.edges(spark, d))


@query()
def prf_sim(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).select(S.ratio_col("x", "y").alias("r"), S.token_set_col("x", "y").alias("t"))
    return p.agg(F.round(F.avg("r"), 6).alias("ratio"), F.round(F.avg("t"), 6).alias("token_set"))


@query()
def aug_noise(spark: SparkSession, d: str) -> DataFrame:
    return augment.add_noise(X.s1(spark, d))


@query()
def aug_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The four sets of training pairs; half of the labelled records are kept for the matcher."""
    held = sampling.bucketed(labelled(spark, d), "s1", 0.5)
    return augment.pair_sets(X.s1(spark, d), X.pool(spark, d), X.edges(spark, d), X.buckets(spark, d), held)


@query(f"""WITH {BUCKET_SQL}, {EDGES_SQL} SELECT s1, cand, (n - 1)::INT AS r FROM (SELECT bk.s1, cand, row_number() OVER (PARTITION BY bk.s1 ORDER BY score DESC, cand) AS n FROM bk LEFT JOIN edges e ON e.s1 = bk.s1 AND e.mid = cand WHERE e.mid IS NULL AND score IS NOT NULL) WHERE n <= 10""")
def aug_hardneg(spark: SparkSession, d: str) -> DataFrame:
    return augment.hard_negatives(X.buckets(spark, d), X.edges(spark, d))


@query(f"""WITH {RANKED}, {EDGES_SQL}, {POOL_SQL}, one AS (SELECT min(s1) AS s1 FROM edges WHERE s1 IN (SELECT s1 FROM bk))
SELECT r::INT AS r, cand, business_name, round(score, 6) AS score, (e.mid IS NOT NULL) AS is_true FROM rk JOIN one USING (s1) JOIN pool ON pool.entity_id = cand LEFT JOIN edges e ON e.s1 = rk.s1 AND e.mid = cand""")
def view_s1(spark: SparkSession, d: str) -> DataFrame:
    b = ranked(spark, d)
    one = truth(spark, d).join(b.select("s1"), "s1", "left_semi").agg(F.min("s1").alias("s1"))
    x = b.join(one, "s1").join(X.pool(spark, d).select(c("entity_id").alias("cand"), N), "cand").join(truth(spark, d).withColumn("_t", F.lit(True)), ["s1", "cand"], "left")
    return x.select("r", "cand", N, F.round("score", 6).alias("score"), F.coalesce("_t", F.lit(False)).alias("is_true"))
