"""Queries of cleaning, parsing and similarity functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import similarity as S
from linkweave.functions import text as T
from linkweave.plans.registry import query
from linkweave.sources import fixtures as X
from linkweave.sources.fixtures import BUCKET_SQL, EDGES_SQL, POOL_SQL
from linkweave.sources.tables import table

c = F.col
N, A = "business_name", "business_address"


def q(s: str) -> str:
    return s.replace("'", "''")


def fold_sql(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), '{T.FOLD_FROM}', '{T.FOLD_TO}')"


def base_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({fold_sql(x)}, '{T.JUNK}', ' ', 'g'), '\\s+', ' ', 'g'), ' ,.-')"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}} ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def list_sql(words: list[str]) -> str:
    return ", ".join(f"'{q(w)}'" for w in words)


def words_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({fold_sql(x)}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+'), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN regexp_replace(w, '^0+([0-9])', '\\1') ELSE w END)"


NAMES = f"norm AS (SELECT entity_id, regexp_replace({base_sql(N)}, '{T.HONORIFIC}', '') AS s FROM train_source3), tk AS (SELECT entity_id, s, list_filter(list_transform(string_split(s, ' '), lambda t: trim(t, '.')), lambda t: t <> '') AS t FROM norm)"
BASE_A = f"b AS (SELECT entity_id, {base_sql(A)} AS s FROM train_source3)"


def s3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_source3")


def one(spark: SparkSession, d: str, **columns) -> DataFrame:
    return s3(spark, d).select("entity_id", *[v.alias(k) for k, v in columns.items()])


@query(f"SELECT entity_id, {clean_sql(N)} AS name, {clean_sql(A)} AS address FROM train_source3")
def str_clean_lex(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, name=T.clean_lex(N), address=T.clean_lex(A))


@query(f"SELECT entity_id, {base_sql(N)} AS name, {base_sql(A)} AS address FROM train_source3")
def str_baseclean(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, name=T.base_clean(N), address=T.base_clean(A))


@query(f"SELECT entity_id, {fold_sql(N)} AS name FROM train_source3")
def str_fold(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, name=T.fold(N))


@query(f"SELECT entity_id, array_to_string({words_sql(A)}, ' ') AS words FROM train_source3")
def str_words(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, words=F.array_join(T.words(A), " "))


@query(f"SELECT entity_id, regexp_matches({base_sql(N)}, '{T.HONORIFIC}')::INT AS honorific, regexp_replace({base_sql(N)}, '{T.HONORIFIC}', '') AS rest FROM train_source3")
def str_honorific(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, honorific=T.has_honorific(N), rest=T.name_norm(N))


@query(f"""WITH {NAMES}, o AS (SELECT *, list_filter(t, lambda x: x IN ({list_sql(T.LEGAL)})) AS l, list_filter(t, lambda x: x NOT IN ({list_sql(T.LEGAL)})) AS o FROM tk)
SELECT entity_id, array_to_string(l, ' ') AS legal, array_to_string(CASE WHEN len(o) = 0 THEN t ELSE o END, ' ') AS core FROM o""")
def str_legal(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, legal=T.legal_form(N), core=T.core_name(N))


@query(f"WITH {NAMES} SELECT entity_id, regexp_extract(replace(s, ' ', ''), '{T.DOMAIN}', 1) AS stem FROM norm")
def str_domain(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, stem=T.domain_stem(N))


def core_sql(source: str) -> str:
    """Words of the names of a relation (entity_id, country, core) that are no legal form; all words where nothing else is left."""
    return f"""cn AS (SELECT entity_id, country, list_filter(list_transform(string_split(regexp_replace({base_sql(N)}, '{T.HONORIFIC}', ''), ' '), lambda t: trim(t, '.')), lambda t: t <> '') AS t FROM {source}),
co AS (SELECT entity_id, country, array_to_string(CASE WHEN len(list_filter(t, lambda x: x NOT IN ({list_sql(T.LEGAL)}))) = 0 THEN t ELSE list_filter(t, lambda x: x NOT IN ({list_sql(T.LEGAL)})) END, ' ') AS core FROM cn)"""


# Letters h and w do not part two letters of one code, all others do; the first letter stands for itself.
SOUNDEX_SQL = """sl AS (SELECT entity_id, country, core, regexp_extract_all(regexp_replace(split_part(core, ' ', 1), '[^a-z]', '', 'g'), '.') AS l FROM co),
sk AS (SELECT *, l[1:1] || list_filter(l[2:], lambda x: x NOT IN ('h', 'w')) AS k FROM sl), sd AS (SELECT *, list_transform(k, lambda x: translate(x, 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202')) AS d FROM sk),
sx AS (SELECT entity_id, country, core, CASE WHEN len(l) = 0 THEN '' ELSE rpad(upper(l[1]) || left(array_to_string(list_transform(list_filter(range(2, len(d) + 1), lambda i: d[i] <> '0' AND d[i] <> d[i - 1]), lambda i: d[i]), ''), 3), 4, '0') END AS code FROM sd)"""


@query(f"WITH {core_sql('train_source3')}, {SOUNDEX_SQL} SELECT entity_id, code FROM sx")
def str_soundex(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, code=T.phonetic(N))


@query(f"WITH {BASE_A} SELECT entity_id, coalesce(nullif(regexp_extract(s, '{T.HOUSE}', 1), ''), regexp_extract(s, '{T.HOUSE}', 2)) AS house FROM b")
def str_house_mark(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, house=T.house_marked(A))


@query(f"""WITH {BASE_A} SELECT entity_id, coalesce(list_filter(list_transform(regexp_split_to_array(replace(s, ',', ' '), '\\s+'), lambda t: trim(t, '.')), lambda t: regexp_full_match(t, '[0-9]{{1,4}}'))[1], '') AS house FROM b""")
def str_house_bare(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, house=T.house_bare(A))


@query(f"""WITH {BASE_A} SELECT entity_id, coalesce(nullif(regexp_extract(s, '(?:^|[^0-9])([0-9]{{6}})(?:$|[^0-9])', 1), ''), regexp_extract(s, '(?:^|[^0-9])([0-9]{{5}})(?:$|[^0-9])', 1)) AS pin FROM b""")
def str_pin(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, pin=T.pin(A))


@query("""SELECT entity_id, coalesce(list_filter(regexp_extract_all(coalesce(business_address, ''), '[0-9]+'), lambda x: length(x) IN (5, 6))[-1], '') AS pin FROM train_source3""")
def str_postcode_last(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, pin=T.postcode_last(A))


@query(f"WITH {BASE_A} SELECT entity_id, regexp_replace(s, '{T.PO_BOX}', ' ', 'g') AS rest FROM b")
def str_pobox(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, rest=T.without_box(A))


ABBR_SQL = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ABBREVIATIONS.items()) + " ELSE t END"
NORM_A = f"""{BASE_A}, n AS (SELECT entity_id, s, array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(replace(regexp_replace(s, '{T.PO_BOX}', ' ', 'g'), ',', ' '), '\\s+', ' ', 'g'), ' '), lambda t: trim(t, '.')), lambda t: t <> ''), lambda t: {ABBR_SQL}), ' ') AS norm FROM b)"""


@query(f"WITH {NORM_A} SELECT entity_id, norm FROM n")
def str_abbr(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, norm=T.addr_norm(A))


@query(f"WITH {NORM_A} SELECT entity_id, array_to_string(list_sort(list_distinct(string_split(norm, ' '))), ' ') AS tokens FROM n")
def str_streettok(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, tokens=T.street_tokens(A))


def map_sql(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{q(k)}' THEN '{q(v)}'" for k, v in table.items()) + " END"


def region_sql(p: str) -> str:
    tails = [f"CASE WHEN len(regexp_split_to_array({p}, '\\s+')) >= {n} AND array_to_string(regexp_split_to_array({p}, '\\s+')[-{n}:], ' ') IN ({list_sql(T.FR_REGIONS)}) THEN array_to_string(regexp_split_to_array({p}, '\\s+')[-{n}:], ' ') END" for n in (4, 3, 2, 1)]
    return f"coalesce({', '.join(tails)})"


STATE_SQL = f"""src AS (SELECT entity_id, business_address FROM train_source3 UNION ALL SELECT entity_id, business_address FROM test_source1),
pp AS (SELECT entity_id, list_filter(list_transform(string_split({base_sql(A)}, ','), lambda p: trim(p, ' ')), lambda p: p <> '') AS p FROM src),
l AS (SELECT entity_id, p, p[-1] AS last, regexp_split_to_array(p[-1], '\\s+') AS w FROM pp),
o AS (SELECT *, upper(trim(w[-1], '.')) AS one, CASE WHEN len(w) >= 2 THEN w[-2] || ' ' || w[-1] ELSE '' END AS two FROM l),
st AS (SELECT *, CASE WHEN one IN ({list_sql(T.US_CODES)}) THEN one WHEN two IN ({list_sql(list(T.US_NAMES))}) THEN {map_sql('two', T.US_NAMES)}
WHEN two IN ({list_sql(T.IN_NAMES)}) THEN two WHEN upper(w[-1]) IN ({list_sql(list(T.IN_CODES))}) THEN {map_sql('upper(w[-1])', T.IN_CODES)}
ELSE coalesce({region_sql('last')}, list_filter(list_transform(w, lambda t: {map_sql('t', T.NATIVE_STATES)}), lambda t: t IS NOT NULL)[1]) END AS state FROM o),
f AS (SELECT *, coalesce(state, CASE WHEN len(p) >= 2 THEN list_filter(list_transform(p, lambda x: {region_sql('x')}), lambda x: x IS NOT NULL)[1] END, '') AS code FROM st)"""


CITY_SQL = f"""CASE WHEN len(p) < 2 THEN '' WHEN state IS NOT NULL THEN trim(regexp_replace(p[-2], '[0-9]+', '', 'g'), ' ')
WHEN code <> '' THEN coalesce(list_filter(p, lambda x: {region_sql('x')} IS NULL AND NOT regexp_matches(x, '^[0-9]') AND length(x) > 2)[1], '') ELSE '' END"""


@query(f"WITH {STATE_SQL} SELECT entity_id, code AS state, {CITY_SQL} AS city FROM f")
def str_citystate(spark: SparkSession, d: str) -> DataFrame:
    rows = s3(spark, d).select("entity_id", A).unionByName(table(spark, d, "test_source1").select("entity_id", A))
    return rows.select("entity_id", T.state_code(A).alias("state"), T.city(A).alias("city"))


@query(f"WITH {BASE_A} SELECT entity_id, regexp_matches(s, '{T.LANDMARK}')::INT AS landmark FROM b")
def str_landmark(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, landmark=T.landmark(A))


@query(f"""WITH {STATE_SQL}, {NORM_A}, ci AS (SELECT entity_id, {CITY_SQL} AS city FROM f)
SELECT n.entity_id, (norm = '')::INT AS empty_addr, (NOT regexp_matches(s, '(^|[^0-9])[0-9]{{5,6}}($|[^0-9])'))::INT AS missing_pin, (city = '')::INT AS missing_city FROM n JOIN (SELECT DISTINCT * FROM ci) USING (entity_id)""")
def str_flags(spark: SparkSession, d: str) -> DataFrame:
    return T.processed(s3(spark, d)).select("entity_id", "empty_addr", "missing_pin", "missing_city")


@query(f"""WITH r AS (SELECT entity_id, list_transform(string_split(coalesce(business_address, ''), ','), lambda p: {words_sql('p')}) AS parts FROM train_source3),
o AS (SELECT entity_id, parts, list_transform(parts, lambda p: list_filter(p, lambda w: NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({list_sql(T.STREET_TYPES + T.STREET_STOPS)}) AND length(w) > 1)) AS own,
list_transform(parts, lambda p: len(list_filter(p, lambda w: regexp_full_match(w, '[0-9]+') OR w IN ({list_sql(T.STREET_TYPES)}))) > 0) AS told FROM r),
k AS (SELECT *, list_filter(range(1, len(parts) + 1), lambda i: told[i] AND len(own[i]) > 0)[1] AS pos FROM o)
SELECT entity_id, CASE WHEN pos IS NULL THEN '' ELSE array_to_string(own[pos], ' ') END AS street,
CASE WHEN pos IS NULL THEN '' ELSE coalesce(list_filter(flatten(parts[1:pos]), lambda w: regexp_full_match(w, '[0-9]+'))[1], '') END AS house FROM k""")
def str_streetof(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, x=T.street_of(A)).select("entity_id", "x.street", "x.house")


@query(f"""WITH {NAMES}, o AS (SELECT *, list_filter(t, lambda x: x NOT IN ({list_sql(T.LEGAL)})) AS o FROM tk)
SELECT entity_id, regexp_replace(lower(coalesce(nullif(regexp_extract(replace(s, ' ', ''), '{T.DOMAIN}', 1), ''), nullif(array_to_string(CASE WHEN len(o) = 0 THEN t ELSE o END, ' '), ''), s)), '[^0-9a-z]', '', 'g') AS compact FROM o""")
def str_compact(spark: SparkSession, d: str) -> DataFrame:
    return T.processed(s3(spark, d)).select("entity_id", T.compact_of("domain_stem", "name_lat", "name_norm").alias("compact"))


@query(r"SELECT entity_id, regexp_matches(business_name, '[^\x{0000}-\x{024F}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}\x{20A0}-\x{20CF}]') AS native FROM train_source3")
def str_native(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, native=T.is_native(N))


@query(r"SELECT entity_id, regexp_matches(trim(business_name), '^[@#]\S+$') AS handle FROM train_source3")
def str_handle(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, handle=T.is_handle(N))


@query(f"""WITH x AS (SELECT entity_id, coalesce(business_name, '') AS raw, {base_sql(N)} AS b, regexp_replace({base_sql(N)}, '{T.HONORIFIC}', '') AS s FROM train_source3)
SELECT entity_id, CASE WHEN regexp_matches(raw, '[^\\x{{0000}}-\\x{{024F}}\\x{{1E00}}-\\x{{1EFF}}\\x{{2000}}-\\x{{206F}}\\x{{20A0}}-\\x{{20CF}}]') THEN 'native' WHEN regexp_extract(replace(s, ' ', ''), '{T.DOMAIN}', 1) <> '' THEN 'domain'
WHEN regexp_matches(b, '{T.HONORIFIC}') THEN 'honorific' ELSE 'plain' END AS tag FROM x""")
def str_casetag(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, tag=T.case_tag(N))


@query(r"""SELECT entity_id, CASE WHEN regexp_matches(business_name, '[\x{0900}-\x{0DFF}]') THEN business_name ELSE '' END AS native FROM train_source3""")
def str_nativetext(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d, native=F.when(c(N).rlike(r"[\x{0900}-\x{0DFF}]"), c(N)).otherwise(""))


KEYS_SQL = f"""kx AS (SELECT entity_id, country, {clean_sql(N)} AS n, {clean_sql(A)} AS a FROM {{0}}), keys AS (SELECT entity_id, country, n AS name_clean, a AS addr_clean,
nullif(regexp_extract(n, '(\\b[0-9]{{{{5,6}}}}\\b)', 1), '') AS pin, nullif(regexp_extract(a, '([0-9]{{{{1,6}}}})', 1), '') AS hnum,
CASE WHEN length(split_part(n, ' ', 1)) >= 3 THEN split_part(n, ' ', 1) END AS first_tok,
CASE WHEN length(left(replace(n, ' ', ''), 4)) = 4 THEN left(replace(n, ' ', ''), 4) END AS nprefix, left(regexp_replace(n, '[aeiou ]', '', 'g'), 8) AS phon FROM kx)""".replace("{{L}}", "{L}").replace("{{M}}", "{M}").replace("{{N}}", "{N}")


def keys_sql(source: str) -> str:
    return KEYS_SQL.replace("{{", "{").replace("}}", "}").replace("{0}", source)


@query(f"WITH {keys_sql('train_source3')} SELECT entity_id, pin, hnum, first_tok, nprefix, phon FROM keys")
def str_keys(spark: SparkSession, d: str) -> DataFrame:
    return T.with_keys(s3(spark, d)).select("entity_id", "pin", "hnum", "first_tok", "nprefix", "phon")


def numkeys_sql(source: str) -> str:
    return f"""nk AS (SELECT entity_id, country, list_distinct(list_transform(regexp_extract_all({fold_sql(A)}, '[0-9a-z]*[0-9][0-9a-z]*'), lambda n: regexp_replace(n, '^0+([0-9a-z])', '\\1'))) AS nums,
list_distinct(list_filter(regexp_extract_all({fold_sql(A)}, '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ({list_sql([*T.STREET_TYPES, *T.STREET_STOPS, 'null', 'nan', 'none'])}))) AS ws FROM {source}),
n1 AS (SELECT entity_id, country, unnest(nums) AS n, ws FROM nk), numkeys AS (SELECT entity_id, country, n || '|' || unnest(ws) AS key FROM n1)"""


@query(f"WITH {numkeys_sql('train_source3')} SELECT entity_id, key FROM numkeys")
def str_numkeys(spark: SparkSession, d: str) -> DataFrame:
    return s3(spark, d).select("entity_id", F.explode(T.number_keys(A)).alias("key"))


@query(f"""WITH {core_sql('train_source1')}, {SOUNDEX_SQL} SELECT entity_id, country || '|' || code || '|' || left(core, 4) AS key FROM sx""")
def str_blockkey(spark: SparkSession, d: str) -> DataFrame:
    return X.s1(spark, d).select("entity_id", T.block_key(N).alias("key"))


WORDMAP = f"""{EDGES_SQL}, {POOL_SQL}, wp AS (SELECT t, unnest(es) AS e FROM (SELECT unnest(string_split(lower(b.business_name), ' ')) AS t, string_split(lower(a.business_name), ' ') AS es FROM edges e JOIN train_source1 a ON a.entity_id = e.s1 JOIN pool b ON b.entity_id = e.mid)),
al AS (SELECT t, e, count(*) AS n FROM wp WHERE length(t) > 2 AND left(t, 1) = left(e, 1) GROUP BY 1, 2), wm AS (SELECT t, e, n FROM (SELECT *, sum(n) OVER (PARTITION BY t) AS all_n, row_number() OVER (PARTITION BY t ORDER BY n DESC, e) AS r FROM al) WHERE r = 1 AND n >= 20 AND n >= 0.6 * all_n)"""


@query(f"""WITH {WORDMAP}, ws AS (SELECT entity_id, unnest(string_split(lower(business_name), ' ')) AS t, generate_subscripts(string_split(lower(business_name), ' '), 1) AS i FROM (SELECT DISTINCT entity_id, business_name FROM train_source3))
SELECT entity_id, string_agg(coalesce(e, ws.t), ' ' ORDER BY i) AS name FROM ws LEFT JOIN wm ON wm.t = ws.t GROUP BY 1""")
def str_wordmap(spark: SparkSession, d: str) -> DataFrame:
    """Names rewritten by the word map that labelled pairs teach."""
    from linkweave.operators.wordmap import aligned_words, apply_table, learn_map

    learned = learn_map(aligned_words(pairs(spark, d), "y", "x"))
    names = s3(spark, d).select("entity_id", F.lower(N).alias("name")).distinct()
    return apply_table(names, "entity_id", "name", learned.select("t", "e"))


@query(f"""WITH {NAMES.replace(", tk AS", ", tkx AS")}, {NORM_A} SELECT r.entity_id, CASE WHEN trim(coalesce(r.business_address, '')) = '' THEN r.business_name ELSE r.business_name || ' | ' || r.business_address END AS raw,
CASE WHEN trim(n.norm) = '' THEN norm.s ELSE norm.s || ' | ' || n.norm END AS processed FROM (SELECT DISTINCT entity_id, business_name, business_address FROM train_source3) r JOIN (SELECT DISTINCT entity_id, s FROM norm) norm USING (entity_id) JOIN (SELECT DISTINCT entity_id, norm FROM n) n USING (entity_id)""")
def str_textmode(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.wordmap import text_of

    return s3(spark, d).select("entity_id", text_of("raw").alias("raw"), text_of("processed").alias("processed")).distinct()


@query()
def str_textmode_latin(spark: SparkSession, d: str) -> DataFrame:
    """The two modes that write other scripts in Latin."""
    from linkweave.operators.wordmap import text_of

    return s3(spark, d).select("entity_id", text_of("fixed").alias("fixed"), text_of("latin").alias("latin"))


@query()
def str_translit(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.functions.script import transliterate_col

    return s3(spark, d).filter(T.is_native(N)).select("entity_id", N, transliterate_col(N).alias("latin"))


@query()
def str_xlit(spark: SparkSession, d: str) -> DataFrame:
    """Names in another script written in Latin word by word, each distinct word once."""
    from linkweave.functions.script import transliterate_words

    return transliterate_words(s3(spark, d).filter(T.is_native(N)).select("entity_id", N).distinct(), "entity_id", N)


@query()
def agg_wordmap(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.functions.script import transliterate_col
    from linkweave.operators.wordmap import aligned_words, learn_map

    owner = X.edges(spark, d).join(X.pool(spark, d).withColumnRenamed("entity_id", "mid"), "mid").select("s1", transliterate_col(N).alias("t"), T.is_native(N).alias("native"))
    names = X.s1(spark, d).select(c("entity_id").alias("s1"), F.lower(N).alias("e"))
    return learn_map(aligned_words(owner.filter("native").join(names, "s1"), "t", "e"))


@query("""WITH t AS (SELECT doc_id, n_chars, CASE doc_id % 3 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN ' ' || (n_chars / 1000.0)::DECIMAL(18, 3)::VARCHAR || 'K' ELSE (n_chars * 10)::VARCHAR || 'm' END AS said FROM documents WHERE n_chars IS NOT NULL)
SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN n_chars * 10000000 ELSE n_chars END AS size FROM t""")
def str_size(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as people write them: plain, in thousands and in millions."""
    n = c("n_chars")
    said = F.when(c("doc_id") % 3 == 0, n.cast("string")).when(c("doc_id") % 3 == 1, F.concat(F.lit(" "), (n / 1000).cast("decimal(18,3)").cast("string"), F.lit("K"))).otherwise(F.concat((n * 10).cast("string"), F.lit("m")))
    return table(spark, d, "documents").filter("n_chars IS NOT NULL").select("doc_id", T.size(said).alias("size"))


# ---- arrays, maths, JSON


@query(f"WITH {EDGES_SQL} SELECT s1, mid FROM edges")
def arr_explode(spark: SparkSession, d: str) -> DataFrame:
    return X.edges(spark, d)


@query("SELECT entity_id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(business_name), ' '), lambda w: length(w) > 3))), ' ') AS words FROM train_source1")
def arr_eval(spark: SparkSession, d: str) -> DataFrame:
    w = F.filter(F.split(F.lower(N), " "), lambda x: F.length(x) > 3)
    return X.s1(spark, d).select("entity_id", F.array_join(F.array_sort(F.array_distinct(w)), " ").alias("words"))


@query("SELECT entity_id, string_split(business_name, ' ')[1] AS first, string_split(business_name, ' ')[-1] AS last, len(string_split(business_name, ' '))::INT AS n FROM train_source1")
def arr_access(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(N, " ")
    return X.s1(spark, d).select("entity_id", w[0].alias("first"), F.element_at(w, -1).alias("last"), F.size(w).alias("n"))


@query()
def hash_bucket(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.sampling import bucketed

    return bucketed(X.s1(spark, d).select("entity_id"), "entity_id", 0.1)


@query(f"""WITH {BUCKET_SQL} SELECT s1, cand, round(ln(1 + rank), 6) AS l, round(sqrt(abs(score)), 6) AS s, greatest(0.0, least(1.0, score)) AS clip, round(score / nullif(cosine - 1, 0), 6) AS safe FROM bk WHERE score IS NOT NULL""")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    b = X.buckets(spark, d).filter("score IS NOT NULL")
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))
    return b.select("s1", "cand", F.round(F.log1p("rank"), 6).alias("l"), F.round(F.sqrt(F.abs("score")), 6).alias("s"), clip.alias("clip"), F.round(c("score") / F.nullif(c("cosine") - 1, F.lit(0.0)), 6).alias("safe"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ---- pair similarity over the labelled pairs

PAIRS_SQL = f"""{EDGES_SQL}, {POOL_SQL}, pairs AS (SELECT e.s1, e.mid, lower(a.business_name) AS x, lower(b.business_name) AS y, string_split(lower(a.business_name), ' ') AS tx, string_split(lower(b.business_name), ' ') AS ty
FROM edges e JOIN train_source1 a ON a.entity_id = e.s1 JOIN pool b ON b.entity_id = e.mid)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    a = X.s1(spark, d).select(c("entity_id").alias("s1"), F.lower(N).alias("x"))
    b = X.pool(spark, d).select(c("entity_id").alias("mid"), F.lower(N).alias("y"))
    p = X.edges(spark, d).join(a, "s1").join(b, "mid")
    return p.withColumns({"tx": F.split("x", " "), "ty": F.split("y", " ")})


def scored(spark: SparkSession, d: str, **columns) -> DataFrame:
    return pairs(spark, d).select("s1", "mid", *[v.alias(k) for k, v in columns.items()])


@query()
def sim_ratio(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, sim=S.ratio_col("x", "y"))


@query()
def sim_tokenset(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, sim=S.token_set_col("x", "y"))


@query()
def sim_tokensort(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, sim=S.token_sort_col("x", "y"))


@query()
def sim_partial(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, sim=S.partial_col("x", "y"))


@query(f"WITH {PAIRS_SQL} SELECT s1, mid, round(jaro_winkler_similarity(x, y), 6) AS sim FROM pairs WHERE regexp_full_match(x || y, '[ -~]+')")
def sim_jw(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).filter(F.concat("x", "y").rlike("^[ -~]+$"))
    return p.select("s1", "mid", F.round(S.jaro_winkler_col("x", "y"), 6).alias("sim"))


@query(f"""WITH {PAIRS_SQL}, w AS (SELECT s1, mid, unnest(tx) AS a, ty FROM pairs), v AS (SELECT s1, mid, a, unnest(ty) AS b FROM w)
SELECT DISTINCT s1, mid, a, b FROM v WHERE a <> b AND regexp_full_match(a, '[a-z]{{4,}}') AND regexp_full_match(b, '[a-z]{{4,}}') AND abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= CASE WHEN length(a) < 6 THEN 1 ELSE 2 END""")
def sim_lev_near(spark: SparkSession, d: str) -> DataFrame:
    w = pairs(spark, d).select("s1", "mid", F.explode("tx").alias("a"), "ty").select("s1", "mid", "a", F.explode("ty").alias("b"))
    return w.filter((c("a") != c("b")) & S.near_word(c("a"), c("b"))).distinct()


@query(f"WITH {PAIRS_SQL} SELECT s1, mid, CASE WHEN tx[1] <> '' AND ty[1] <> '' THEN (tx[1] = ty[1])::INT END AS same FROM pairs")
def sim_same(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, same=S.same(c("tx")[0], c("ty")[0]))


@query(f"""WITH {PAIRS_SQL} SELECT s1, mid, round(len(list_intersect(tx, ty)) / len(list_distinct(list_concat(tx, ty)))::DOUBLE, 6) AS jaccard, round(len(list_intersect(tx, ty)) / len(list_distinct(tx))::DOUBLE, 6) AS cover FROM pairs""")
def sim_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, jaccard=F.round(S.jaccard(c("tx"), c("ty")), 6), cover=F.round(S.cover(c("tx"), c("ty")), 6))


@query(f"""WITH {PAIRS_SQL}, w AS (SELECT DISTINCT entity_id, country, unnest(string_split(lower(business_name), ' ')) AS tok FROM train_source1), n AS (SELECT count(*) AS n FROM train_source1),
f AS (SELECT tok, count(*) AS df FROM w GROUP BY 1), i AS (SELECT tok, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM f, n), z AS (SELECT ln(n + 1.0) + 1 AS unseen FROM n),
u AS (SELECT s1, mid, unnest(list_distinct(list_concat(tx, ty))) AS tok, tx, ty FROM pairs),
x AS (SELECT s1, mid, list_contains(tx, u.tok) AS a, list_contains(ty, u.tok) AS b, coalesce(idf, unseen) AS w FROM u CROSS JOIN z LEFT JOIN i ON i.tok = u.tok)
SELECT s1, mid, round(coalesce(sum(w) FILTER (a AND b), 0) / sum(w), 5) AS jaccard, round(coalesce(sum(w) FILTER (a AND b), 0) / sum(w) FILTER (a), 5) AS cover,
round(coalesce(max(w) FILTER (a AND NOT b), 0), 5) AS miss_s1, round(coalesce(max(w) FILTER (b AND NOT a), 0), 5) AS miss_cand FROM x GROUP BY 1, 2""")
def sim_idf4(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.features import idf_pairs

    o = idf_pairs(pairs(spark, d), X.s1(spark, d))
    return o.select("s1", "mid", *[F.round(k, 5).alias(k) for k in ("jaccard", "cover", "miss_s1", "miss_cand")])


@query()
def sim_idf4_typo(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.features import idf_pairs_typo

    return idf_pairs_typo(pairs(spark, d), X.s1(spark, d))


@query(f"""WITH {EDGES_SQL}, {POOL_SQL}, p AS (SELECT e.s1, e.mid, string_split(lower(a.business_address), ' ') AS tx, string_split(lower(coalesce(b.business_address, '')), ' ') AS ty FROM edges e JOIN train_source1 a ON a.entity_id = e.s1 JOIN pool b ON b.entity_id = e.mid)
SELECT s1, mid, round(len(list_intersect(tx, ty)) / len(list_distinct(list_concat(tx, ty)))::DOUBLE, 6) AS jaccard FROM p""")
def sim_addrtok(spark: SparkSession, d: str) -> DataFrame:
    a = X.s1(spark, d).select(c("entity_id").alias("s1"), F.split(F.lower(A), " ").alias("tx"))
    b = X.pool(spark, d).select(c("entity_id").alias("mid"), F.split(F.lower(T.text(A)), " ").alias("ty"))
    return X.edges(spark, d).join(a, "s1").join(b, "mid").select("s1", "mid", F.round(S.jaccard(c("tx"), c("ty")), 6).alias("jaccard"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10""")
def sim_cos(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((c("vec_id") - 10).alias("a"), c("vec_id").alias("b"), c("embedding").alias("v"), "label")
    return e.withColumnRenamed("vec_id", "a").join(b, ["a", "label"]).select("a", "b", F.round(S.cosine(c("embedding"), c("v")), 6).alias("sim"))


@query(f"WITH {PAIRS_SQL} SELECT s1, mid, length(x)::INT AS nx, length(y)::INT AS ny FROM pairs")
def sim_len(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, nx=F.char_length("x"), ny=F.char_length("y"))


LEX_SQL = f"{EDGES_SQL}, a AS (WITH {keys_sql('train_source1')} SELECT * FROM keys), b AS (WITH {POOL_SQL}, {keys_sql('pool')} SELECT * FROM keys)"


@query(f"""WITH {LEX_SQL} SELECT e.s1, e.mid, coalesce(a.pin = b.pin, false)::INT AS pin, coalesce(a.hnum = b.hnum, false)::INT AS hnum, coalesce(a.first_tok = b.first_tok, false)::INT AS first,
abs(length(a.name_clean) - length(b.name_clean))::INT AS name_gap, abs(length(a.addr_clean) - length(b.addr_clean))::INT AS addr_gap FROM edges e JOIN a ON a.entity_id = e.s1 JOIN b ON b.entity_id = e.mid""")
def sim_lex8(spark: SparkSession, d: str) -> DataFrame:
    from linkweave.operators.features import lexical_features

    f = lexical_features(X.edges(spark, d).withColumnRenamed("mid", "cand"), X.s1(spark, d), X.pool(spark, d))
    return f.select("s1", c("cand").alias("mid"), "pin", "hnum", "first", "name_gap", "addr_gap")


@query()
def sim_lex8_ratios(spark: SparkSession, d: str) -> DataFrame:
    """The three ratios of the eight lexical features."""
    from linkweave.operators.features import lexical_features

    f = lexical_features(X.edges(spark, d).withColumnRenamed("mid", "cand"), X.s1(spark, d), X.pool(spark, d))
    return f.select("s1", c("cand").alias("mid"), "name_ratio", "name_set", "addr_ratio")
