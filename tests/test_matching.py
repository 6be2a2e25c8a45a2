"""Operators that SQL does not say: features by hand, fitted trees, noise, word maps, samples, approximate search, cache."""

import random

import numpy as np
import pytest

from linkweave.functions import script
from linkweave.operators import augment, dense, features, matcher, sampling, windows, wordmap
from linkweave.sources import cache

RECORD = "entity_id string, country string, business_name string, business_address string"
BUCKET = "s1 string, cand string, country string, source string, score double, cosine double, rank int, e5_rank int, rev_rank int, addr_key int, name_rank int, num_key int, empty_rank int, empty_rev_rank int"


@pytest.fixture(scope="module")
def frame(spark):
    left = spark.createDataFrame([("S1-1", "US", "Alpha Foods LLC", "12 Main Street, Springfield 90210, CA"), ("S1-2", "US", "Beta Tools", "7 Oak Road, Salem 44101, OH")], RECORD)
    right = [("S2-1", "US", "alpha foods", "12 Main St, Springfield 90210, CA"), ("S2-2", "US", "Alpha Food", "99 Elm Street, Springfield 90210, CA"), ("S3-1", "US", "betatools.com", None), ("S2-3", "US", "Dr. Gamma", "")]
    pairs = [("S1-1", "S2-1", "S2", 0.9, 0.95), ("S1-1", "S2-2", "S2", 0.7, 0.9), ("S1-1", "S3-1", "S3", None, 0.2), ("S1-1", "S2-3", "S2", 0.1, None), ("S1-2", "S3-1", "S3", 0.6, 0.8), ("S1-2", "S2-1", "S2", 0.3, 0.1)]
    bucket = spark.createDataFrame([(s, c, "US", k, x, y, None, None, None, None, None, None, None, None) for s, c, k, x, y in pairs], BUCKET)
    rows = features.pair_features(bucket, left, spark.createDataFrame(right, RECORD)).collect()
    return {(r.s1, r.cand): r.asDict() for r in rows}


def test_features_by_hand(frame):
    a, b, web, other = (frame["S1-1", c] for c in ("S2-1", "S2-2", "S3-1", "S2-3"))
    assert len(frame) == 6 and len(a) == 88
    assert [x["rank"] for x in (a, b, other, web)] == [0, 1, 2, 3] and a["s1_best_cosine"] == 0.95 and round(b["gap_to_best_score"], 6) == 0.2 and round(a["gap_to_next_score"], 6) == 0.2
    assert (a["cand_n_s1"], a["cand_rank"], round(a["cand_margin"], 6)) == (2, 0, 0.6) and round(frame["S1-2", "S2-1"]["cand_margin"], 6) == -0.6
    assert round(a["s1_top5_cosine"], 6) == round((0.95 + 0.9 + 0.2) / 3, 6)
    assert round(a["name_ratio"], 4) == round(200 * 11 / 26, 4) and a["name_token_set"] == 100 and a["name_partial"] == 100 and a["core_ratio"] == 100 and a["core_jaro_winkler"] == 1
    assert (a["s1_name_len"], a["cand_name_len"]) == (15, 11) and a["legal_form_same"] is None and a["phonetic_same"] == 1
    assert a["addr_token_set"] == 100 and a["postcode_same"] == 1 and a["city_same"] == 1 and a["state_same"] == 1 and b["postcode_same"] == 1
    assert a["numbers_jaccard"] == 1 and round(b["numbers_jaccard"], 6) == round(1 / 3, 6) and b["numbers_cover"] == 0.5
    assert (web["cand_is_s3"], web["cand_web_name"], web["cand_empty_address"], other["cand_honorific"]) == (1, 1, 1, 1) and web["addr_ratio"] is None
    assert frame["S1-2", "S3-1"]["compact_ratio"] == 100
    assert a["name_token_set_gap_best"] == 0 and a["name_token_set_rank"] == 0 and a["n_name_twins"] >= 1
    # A candidate with a name at least as close and an address ten points closer: the first beats all others.
    assert a["better_addr_same_name"] == 0 and b["better_addr_same_name"] == 1 and other["better_addr_same_name"] >= 1


def test_only_features_are_kept_of_a_pair(spark, monkeypatch):
    """What is written between the two passes holds neither texts nor words of the sides, which are larger than all features."""
    kept = []
    monkeypatch.setattr(features, "cut", lambda df: kept.append(df.dtypes) or df)
    record = spark.createDataFrame([("x", "US", "Alpha", "1 Main Street")], RECORD)
    features.pair_features(spark.createDataFrame([], BUCKET), record, record)
    assert len(kept) == 1 and {k for k, t in kept[0] if t.startswith(("struct", "array", "map", "string"))} == {"s1", "cand", "country"}


def test_word_weights_by_hand(frame):
    """Weights ln(3 / (df + 1)) + 1 of the two clean names; a word of no clean name weighs 12."""
    w = np.log(3 / 2) + 1
    b = frame["S1-1", "S2-2"]
    assert round(b["name_idf_jaccard"], 5) == round(w / (w + w + w + 12), 5) and round(b["name_idf_cover"], 5) == round(1 / 3, 5)
    assert round(b["name_idf_miss_s1"], 5) == round(w, 5) and b["name_idf_miss_cand"] == 12
    # food and foods are a typo apart and count as shared in the other four
    assert round(b["name_idf_cover_fuzzy"], 5) == round(2 / 3, 5) and b["name_idf_miss_cand_fuzzy"] == 0


def test_dominated_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(g, f"{g}{i}", rng.choice([None, 0.5, 1.0, rng.random()]), rng.choice([None, 1.5, rng.random() * 3])) for g, n in (("x", 1), ("y", 2), ("z", 90), ("h", 257)) for i in range(n)]
    got = {(r.g, r.i): r.better for r in windows.dominated(spark.createDataFrame(rows, "g string, i string, a double, b double"), "g", "i", "a", "b", 0.3).collect()}
    assert got == {(g, i): sum(h == g and None not in (a, b, c, d) and c >= a and d >= b + 0.3 for h, _, c, d in rows) for g, i, a, b in rows}


def test_trees_learn_and_do_not_leak(spark):
    rng = random.Random(1)
    rows = [(f"s{i // 5}", f"c{i}", "US" if i % 2 else "India", rng.random(), rng.choice([None, rng.random()]), 0) for i in range(600)]
    rows = [(s, c, k, x, y, int(x > 0.6)) for s, c, k, x, y, _ in rows]
    df = spark.createDataFrame(rows, "s1 string, cand string, country string, x double, y double, is_true int")
    out = matcher.out_of_fold(df, ["x", "y"], rounds=5).collect()
    assert len(out) == 600 and len({(r.s1, r.fold) for r in out}) == 120
    assert sum((r.p > 0.5) == bool(r.is_true) for r in out) > 570
    model = matcher.fit(df, ["x", "y"], rounds=5)
    gains = matcher.importance(model, ["x", "y"])
    assert gains[0][0] == "x" and gains[0][1] > 0.8 and gains[0][2] >= 1
    assert {r.country for r in matcher.transfer(df, ["x", "y"], "India", rounds=3).collect()} == {"India"}


def test_early_stop_ends_before_all_rounds(spark):
    rng = random.Random(5)
    noise = spark.createDataFrame([(f"s{i}", rng.random(), rng.randrange(2)) for i in range(400)], "s1 string, x double, is_true int")
    assert len(matcher.fit(noise, ["x"], rounds=30).trees) < 30
    assert len(matcher.fit(noise, ["x"], rounds=3, held=0).trees) == 3


def test_noise():
    rng = random.Random(3)
    for word in ("street", "abcd", "kolkata"):
        made = {augment.typo(word, rng) for _ in range(200)}
        assert all(w[0] == word[0] and abs(len(w) - len(word)) < 2 for w in made) and len(made) > 5
    assert augment.typo("abc", rng) == "abc" and augment.typo("a-bc", rng) == "a-bc"
    steps = {k: augment._step(k, ["Alpha", "Foods", "Ltd"], ["007", "Main", "Street", "Salem"], random.Random(9)) for k in augment.WEIGHTS}
    assert steps["drop_legal"][0] == ["Alpha", "Foods"] and steps["no_address"][1] == [] and steps["number_format"][1][0] == "7" and steps["website"][0][0].startswith("alphafoods.")
    assert len(steps["drop_tail"][1]) in (2, 3) and len(steps["double_word"][0]) == 4 and sorted(steps["move_words"][1]) == sorted(["007", "Main", "Street", "Salem"]) and len(steps["drop_address_word"][1]) == 3
    assert set(steps["swap_words"][0]) == {"Alpha", "Foods", "Ltd"} and steps["swap_words"][0] != ["Alpha", "Foods", "Ltd"]
    assert augment.noisy("Alpha Foods", "12 Main St", 5) == augment.noisy("Alpha Foods", "12 Main St", 5) != ("Alpha Foods", "12 Main St")
    assert augment.noisy("", "", 1) == ("", "")


def test_pair_sets(spark):
    clean = spark.createDataFrame([("S1-1", "India", "Alpha Foods", "1 Main Road"), ("S1-2", "India", "Beta", "2 Oak Road")], RECORD)
    pool = spark.createDataFrame([("S2-1", "India", "अल्फा फूड्स", "1 Main Road"), ("S2-2", "India", "Beta Ltd", None), ("S2-3", "India", "Gamma", "9 Elm")], RECORD)
    edges = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2")], "s1 string, mid string")
    bucket = spark.createDataFrame([("S1-1", "S2-3", 0.5), ("S1-1", "S2-1", 0.9)], "s1 string, cand string, score double")
    held = spark.createDataFrame([("S1-2",)], "s1 string")
    out = augment.pair_sets(clean, pool, edges, bucket, held).collect()
    kinds = {}
    for r in out:
        kinds.setdefault(r.kind, []).append(r)
    assert {k: len(v) for k, v in kinds.items()} == {"matches": 1, "script_matches": 1, "noisy": 5, "script": 1}
    m = kinds["matches"][0]
    assert (m.id, m.other_id, m.negative) == ("S1-1", "S2-1", "Gamma | 9 Elm") and m.positive.isascii() and not kinds["script"][0].positive.isascii()
    assert all(r.anchor != r.positive for r in kinds["noisy"])


def test_word_map_is_learned_and_applied(spark):
    pairs = spark.createDataFrame([("limitd", "limited")] * 20 + [("limitd", "lime")] * 5 + [("rare", "rear")] * 3, "t string, e string")
    learned = wordmap.learn_map(pairs)
    assert [tuple(r) for r in learned.collect()] == [("limitd", "limited", 20)]
    df = spark.createDataFrame([("1", "alpha limitd limitd"), ("2", ""), ("3", None)], "id string, name string")
    assert {r.id: r.name for r in wordmap.apply_table(df, "id", "name", learned.select("t", "e")).collect()}["1"] == "alpha limited limited"


def test_transliteration_rules(spark):
    assert script.transliterate("आनंद").count("n") == 2 and "m" in script.transliterate("अंबर")  # n before d, m before b
    assert "tt" in script.transliterate("ലിമിറ്റഡ്")
    assert script.transliterate_word("लि.") == "ltd" and script.transliterate_word("प्रा") == "pvt"
    model = lambda w, s: f"{s}:{len(w)}"
    assert script.transliterate_word("लिमिटेड", model) == "devanagari:7" and script.transliterate_word("कम", model) == script.transliterate("कम")
    df = spark.createDataFrame([("1", "कम  Foods"), ("2", None)], "id string, name string")
    assert [tuple(r) for r in script.transliterate_words(df, "id", "name").collect()] == [("1", script.transliterate("कम") + " foods")]


def test_samples(spark):
    df = spark.range(1000).selectExpr("cast(id AS string) AS entity_id", "id % 50 = 0 AS rare", "CASE WHEN id % 10 = 0 THEN 'linked' WHEN id % 10 < 8 THEN 'no_match' ELSE 'other_owner' END AS kind")
    rare = {"rare": df.rare}
    out = sampling.tag_minimum(df, rare, "entity_id", 200).collect()
    assert len(out) == 200 and sum(r.rare for r in out) >= 10 and len({r.entity_id for r in out}) == 200
    share = sampling.linked_share(df, "kind", rare, "entity_id", 200).collect()
    by = {k: sum(r.kind == k for r in share) for k in ("linked", "no_match", "other_owner")}
    assert by == {"linked": 100, "no_match": 60, "other_owner": 40} and len({r.entity_id for r in share}) == 200
    assert sampling.linked_share(df.limit(0), "kind", rare, "entity_id", 10).count() == 0


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 16))
    x = np.repeat(centre, 50, axis=0) + 0.4 * rng.standard_normal((2000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    q, p = spark.createDataFrame(rows[:200] + rows[-1:], "q long, v array<double>"), spark.createDataFrame(rows, "c long, v array<double>")
    exact = {(r.q, r.c) for r in dense.dense_top(q, p, 10, block=300).collect()}
    found = {(r.q, r.c) for r in dense.ivf_top(q, p, 10, sample=1000).collect()}
    assert len(exact) == 2000 and len(exact & found) >= 0.9 * len(exact)
    assert dense.ivf_top(q.limit(0), p, 3).count() == 0


def test_dense_search_within_groups_and_ties(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "a", [3.0, 0.0]), (4, "b", [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, "a", None)]
    df = spark.createDataFrame(rows, "q long, g string, v array<double>")
    got = sorted((r.q, r.c, r.r) for r in dense.dense_top(df, df.withColumnRenamed("q", "c"), 1, within="g", not_self=True, block=1).collect())
    assert got == [(1, 2, 0), (2, 1, 0), (3, 1, 0)]


def test_cache_reuse(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b")], "id string, t string")
    made = []
    build = lambda x: made.append(1) or x.groupBy("id").count()
    path = str(tmp_path / "c")
    for inputs, settings, reused in ((df, {"k": 1}, False), (df.repartition(3), {"k": 1}, True), (df.distinct(), {"k": 1}, False), (df.distinct(), {"k": 2}, False)):
        out, hit = cache.reuse(path, inputs, settings, build)
        assert hit == reused and out.count() == 2
    assert len(made) == 3
