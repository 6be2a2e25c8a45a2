import pytest

from linkweave.operators import blocking, decide, dense, metrics, sampling, validate
from linkweave.sources import tsv

RECORDS = "entity_id string, country string, business_name string, business_address string"


@pytest.fixture(scope="module")
def records(spark):
    left = [("S1-1", "US", "Alpha Beta Foods", "12 Main St"), ("S1-2", "US", "Gamma", None), ("S1-3", "FR", "Delta", "")]
    right = [("S2-1", "US", "alpha foods", "12 Main Street"), ("S2-2", "US", "Gamma", "-"), ("S3-1", "IN", "Delta", "1 x"), ("S3-2", None, None, None)]
    return spark.createDataFrame(left, RECORDS), spark.createDataFrame(right, RECORDS)


def test_lexical_block(records):
    got = {(r.s1, r.cand): r.nkeys for r in blocking.lexical_block(*records).collect()}
    assert got[("S1-1", "S2-1")] >= 3 and ("S1-2", "S2-2") in got and not any(a == "S1-3" for a, _ in got)


def test_unseen_country_meets_all(records):
    left, right = (t.select("entity_id", "country", t.business_name.alias("k")) for t in records)
    assert ("S1-3", "S3-1") in {(r.s1, r.cand) for r in blocking.by_country(left, right, "k").collect()}


def test_empty_tables(spark, records):
    none = spark.createDataFrame([], RECORDS)
    assert blocking.lexical_block(none, records[1]).count() == 0
    a, b = blocking.tfidf(*[none.select("entity_id", "country", none.business_name.alias("t"))] * 2, "t")
    assert blocking.sparse_top(a, b, 3).count() == 0


def test_name_searches_against_sql(spark, tmp_path):
    """Also for an id with several rows or countries, equal names, and names that share nothing; no vector and no answer is shuffled."""
    import random

    import duckdb

    from linkweave.plans import registry

    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "stone", "river", "hill", "a", "ab", "\u0928\u092e\u0938", "x1"] + [f"w{i}q{i % 7}" for i in range(900)]
    name = lambda: rng.choice([" ".join(rng.sample(words, rng.randint(1, 4))), "Alpha  Beta", "", None])
    clean = [(f"S1-{i}", name(), f"{i}", rng.choice(["US", "India", None])) for i in range(900)]
    noisy = [[(f"S{s}-{i}", name(), str(i), rng.choice(["US", "India", "Chile"])) for i in range(900)] for s in (2, 3)]
    noisy[0] += [("S2-1", "Stone River Hill", "x", "US"), ("S2-1", "Stone River Hill", "y", "US"), ("S2-2", "Omega Stone", "y", "India")]
    db = duckdb.connect()
    for table, rows in (("train_source1", clean), ("train_source2", noisy[0]), ("train_source3", noisy[1])):
        spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string").write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for query in ("blk_name3g", "jn_sparse_topk"):
        df = registry.queries()[query](spark, str(tmp_path))
        expected = db.execute(f"SELECT s1, cand, sim, r FROM ({registry.oracle_sql()[query]})").fetchall()
        assert {tuple(r) for r in df.select("s1", "cand", "sim", "r").collect()} == set(expected) and len(expected) > 60
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan.split("MapInPandas")[0], plan


@pytest.mark.parametrize("held", [3, 100_000])
def test_text_search_in_runs(spark, held):
    """The same best, whatever passes by at once: 1,500 similar names, of which thousands of pairs are equal or nearly so."""
    import random

    rng = random.Random(9)
    name = lambda: " ".join(rng.choice(["north", "south", "river", "stone"]) + rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(2))
    rows = [(f"{i:05}", "US", name()) for i in range(1500)]
    right = spark.createDataFrame(rows, "entity_id string, country string, t string")
    left = right.filter("entity_id < '00040'")
    a, b = blocking.tfidf(left, right, "t")
    expected = {(r.s1, r.r): (r.cand, r.sim) for r in blocking.sparse_top(a, b, 4).collect()}
    assert {(r.s1, r.r): (r.cand, r.sim) for r in blocking.text_top(left, right, "t", 4, held).collect()} == expected and len(expected) == 160


def test_equal_texts_are_searched_once(spark):
    """Copies of a name, also with other order of words, and ties whose ids alternate: the answers of each record, one search a text."""
    names = [f"{a} {b}" for a in ("north", "river", "stone", "hill") for b in ("alpha", "omega", "delta")]
    flip = lambda t: " ".join(reversed(t.split()))
    rows = [(f"{i:05}", "US", f"fill{i}er{i * 7}") for i in range(1500)] + [(f"{i:05}", "US", (flip if i % 5 == 0 else str)(names[i % 12])) for i in range(1500, 1620)]
    right = spark.createDataFrame(rows[700:], "entity_id string, country string, t string")
    left = spark.createDataFrame([(f"a{i}", c, t) for i, c, t in rows[:40] + rows[-60:]] + [("b1", None, "north alpha")], right.schema)
    expected = {(r.s1, r.r): (r.cand, r.sim) for r in blocking.sparse_top(*blocking.tfidf(left, right, "t"), 7).collect()}
    for held in (4, 100_000):
        assert {(r.s1, r.r): (r.cand, r.sim) for r in blocking.text_top(left, right, "t", 7, held).collect()} == expected

    class Count(blocking._Best):
        def __init__(self, first, texts, x, country, k):
            self.asked, self.met, self.most = len(texts), 0, 0

        def meet(self, texts, x, ids):
            self.met, self.most = self.met + len(texts), max(self.most, *map(len, ids))

        def answers(self, i, k):
            return [("", self.asked, self.met, self.most)]

    x, y = (t.selectExpr("entity_id", "country", "text", "0D AS x") for t in (blocking._documents(t, "t") for t in (left, right)))
    got = blocking.passing_by(x.filter("text LIKE '% %'"), y.filter("text LIKE '% %'"), 7, Count, "asked int, met int, most int").collect()
    assert len(got) == 60 and {(r.asked, r.met, r.most) for r in got} == {(12, 12, 7)}


def test_pairs_of_a_common_word(spark, tmp_path):
    """As SQL says, also for ids with several rows and nulls."""
    import duckdb

    from pyspark.sql import functions as F

    from linkweave.plans import registry

    db = duckdb.connect()
    for table, n in (("train_source1", 90), ("test_source1", 70)):
        rows = [(f"{table[:2]}-{i}", f"Shared word{i % 9} x{'' if i % 3 else ' shared'}", None if i % 11 == 0 else "US") for i in range(n)]
        rows += [(*rows[1][:1], "other SHARED", "US"), (*rows[2][:1], None, "US"), *rows[3:5]]
        spark.createDataFrame(rows, "entity_id string, business_name string, country string").withColumn("business_address", F.lit("")).write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    expected = sorted(db.execute(registry.oracle_sql()["jn_token_explode"]).fetchall())
    got = registry.queries()["jn_token_explode"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == expected and len(expected) > 5000


def test_metric_cases(spark):
    rec = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1 string")
    pred = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("c", "9")], "s1 string, cand string")
    true = spark.createDataFrame([("a", "1"), ("a", "3"), ("d", "4")], "s1 string, cand string")
    f = {r.s1: round(r.f, 3) for r in metrics.f_half(rec, pred, true).collect()}
    assert f == {"a": 0.714, "b": 1.0, "c": 0.0, "d": 0.0}


def test_curve_equals_scores(spark):
    rec = spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string")
    own = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.4), ("b", "3", 0.5)], "s1 string, cand string, p double")
    true = spark.createDataFrame([("a", "1"), ("b", "4")], "s1 string, cand string")
    for r in decide.curve(own, true, rec, [0.3, 0.45, 0.95]).collect():
        assert metrics.macro(metrics.f_half(rec, own.filter(own.p >= r.t), true)).first().score == r.score


def test_one_owner_before_cutoff_and_ties(spark):
    p = spark.createDataFrame([("b", "1", 0.7), ("a", "1", 0.7), ("a", "2", 0.2)], "s1 string, cand string, p double")
    assert {(r.s1, r.cand) for r in decide.one_owner(p).collect()} == {("a", "1"), ("a", "2")}


def test_validator(spark):
    text = ["id\tids", "S1-1\tS2-1,S2-1", "S1-1\tS1-2", "S1-9\tX-1,S2-7", "", "broken", "id\tids"]
    lines = spark.createDataFrame([(x,) for x in text], "value string")
    req, known = (spark.createDataFrame([(x,) for x in ids], "entity_id string") for ids in (["S1-1", "S1-2"], ["S2-1"]))
    cands = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S1-2")], "s1 string, cand string")
    got = {r.rule: (r.n, r.examples) for r in validate.check(lines, "id\tids", req, known, cands).collect()}
    one = {"no_tab": "broken", "repeated_row": "S1-1", "repeated_id": "S1-1", "own_id": "S1-2", "wrong_prefix": "X-1", "unknown_id": "S2-7", "missing": "S1-2", "extra": "S1-9"}
    assert got == {k: (1, v) for k, v in one.items()} | {"header": (1, ""), "outside": (2, "S1-9 S2-7 | S1-9 X-1")}
    assert {r.rule: r.n for r in validate.check(lines.limit(0), "id\tids", req, known).collect()}["header"] == 1


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q"', None), ("b", "", "z")], "id string, t string, u string")
    tsv.write_tsv(df, str(tmp_path / "t"))
    back = tsv.read_tsv(spark, str(tmp_path / "t"), ["id", "t", "u"])
    assert {tuple(r) for r in back.collect()} == {("a", 'x "q"', ""), ("b", "", "z")}


def test_dense_against_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    q, p = spark.createDataFrame(rows[:10], "q long, v array<double>"), spark.createDataFrame(rows[10:], "c long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.q, r.r): r.c for r in dense.dense_top(q, p, 3, block=13).collect()}
    assert got == {(i, k): 10 + j for i in range(10) for k, j in enumerate(np.argsort(-(u[i] @ u[10:].T))[:3])}


def test_union_of_searches_with_repeated_ids(spark, tmp_path):
    """An id with two rows makes no pair twice; ranks and scores of the dense searches against brute force, with copies, ties and null names."""
    import random

    import numpy as np

    from linkweave.plans import registry

    rng = random.Random(3)
    words = [f"w{i}q" for i in range(20)] + ["alpha", "Alpha", "beta"]
    name = lambda: rng.choice([" ".join(rng.sample(words, 2)), "Alpha beta", "alpha Beta", None])
    clean = [(f"S1-{i}", name(), f"{i} Main St", rng.choice(["US", "India"])) for i in range(30)]
    noisy = [(f"S2-{i}", name(), f"{i} Main St", rng.choice(["US", "India"])) for i in range(150)]
    noisy += [(n[0], n[1], "N/A", n[3]) for n in noisy[:9]]
    for table, rows in (("train_source1", clean), ("train_source2", noisy), ("train_source3", noisy[:0])):
        spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string").write.parquet(f"{tmp_path}/{table}.parquet")
    rows = registry.queries()["blk_union_dense"](spark, str(tmp_path)).collect()
    got = {(r.s1, r.cand): r for r in rows}
    assert len(got) == len(rows)
    raw = {i: v for t in (clean, noisy) for i, v in zip([r[0] for r in t], dense.hashed([r[1] for r in t]), strict=True)}
    for land in ("US", "India"):
        mean = np.mean([raw[r[0]] for r in noisy if r[3] == land], axis=0)
        unit = {r[0]: (u := raw[r[0]] - mean) / np.linalg.norm(u) for r in clean + noisy if r[3] == land}
        a, b = ([i for i in unit if i.startswith(s)] for s in ("S1", "S2"))
        for asked, held, k, rank in ((a, b, 30, "dense_rank"), (b, a, 2, "reverse_rank")):
            for q in asked:
                best = sorted((-round(float(unit[q] @ unit[h]), 6), h) for h in held)[:k]
                for r, (_, h) in enumerate(best):
                    row = got[(q, h) if asked is a else (h, q)]
                    assert getattr(row, rank) == r
                    cosine = float(raw[q] @ raw[h])
                    assert row.score is None if not raw[q].any() or not raw[h].any() else abs(row.score - cosine) < 1e-6
    assert {r.rank for r in rows if r.s1 == "S1-0"} == set(range(sum(r.s1 == "S1-0" for r in rows)))


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("cast(id AS string) AS entity_id", "cast(id % 3 AS string) AS g")
    a = {r.entity_id for r in sampling.per_group(df, "g", "entity_id", 5).collect()}
    assert a == {r.entity_id for r in sampling.per_group(df.repartition(7), "g", "entity_id", 5).collect()} and len(a) == 15
    assert sampling.folds(df, "g", 3).groupBy("g").agg({"fold": "min"}).count() == 3
