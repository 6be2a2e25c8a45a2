import random

import pytest
from pyspark.sql import functions as F

from linkweave.llm import bpe, packing, skeleton, topn, truncation

public_tokenizers = pytest.importorskip("public_tokenizers")


# ---- consistent form


def test_consistent_cases():
    cases = {
        "Ｆｕｌｌ　Ｗｉｄｔｈ": "Full Width",
        "Coaﬆal": "Coastal",
        "Café": "Café",
        "Café": "Café",
        "a b c": "a b c",
        "in​vi­sible﻿": "invisible",
        "Mеd рrivate": "Med private",
        "Ремонт Обуви Жук": "Ремонт Обуви Жук",
        "Ψωμί & Μέλι": "Ψωμί & Μέλι",
        "Tri‑shul": "Tri-shul",
        "  two  spaces ": "  two  spaces ",
        "Ⅴista": "Vista",
        "बाल्‍पो": "बाल्‍पो",
        "बाल‍ ": "बाल ",
        "": "",
        None: None,
    }
    for given, expected in cases.items():
        assert skeleton.consistent(given) == expected, given
        assert skeleton.consistent(skeleton.consistent(given)) == expected


def test_public_table_of_lookalikes(spark):
    """The table reaches scripts that the built-in one lacks; words that can't be read as Latin, letters like digits and signs stay."""
    look = skeleton.Lookalikes(skeleton.confusables(spark))
    if not look.prototypes:
        pytest.skip("no ICU library beside Spark")
    cases = {
        "\u13aalpha": "Alpha", "\ua4d0eta": "Beta", "\u2c9fne": "one", "\u03f2at": "cat", "\u041f\u0438\u0440\u043e\u0433": "\u041f\u0438\u0440\u043e\u0433", "\u03a8\u03c9\u03bc\u03af": "\u03a8\u03c9\u03bc\u03af",
        "\uff3bA\uff3d": "[A]", "2 \u00d7 3": "2 \u00d7 3", "Caf\u00e9": "Caf\u00e9", "\u092c\u093e\u0932\u094d\u200d\u092a\u094b": "\u092c\u093e\u0932\u094d\u200d\u092a\u094b", "": "",
    }
    for given, expected in cases.items():
        assert skeleton.consistent(given, look) == expected, ascii(given)
        assert skeleton.consistent(expected, look) == expected, ascii(expected)
    assert skeleton.skeleton("\u0406l1|", look) == skeleton.skeleton("lIl1", look) == "llll" and skeleton.skeleton("rn", look) == skeleton.skeleton("m", look)
    assert skeleton.skeleton(None, look) is None and skeleton.skeleton("", look) == ""
    plain = "".join(map(chr, range(32, 127)))
    df = spark.createDataFrame([(plain,)], "value string")
    assert df.select(skeleton._plain_skeleton(F.col("value"), look.prototypes)).first()[0] == skeleton.skeleton(plain, look)


def test_no_table_of_lookalikes_is_an_error(spark):
    """Without the library, or with an answer that lacks characters, nothing is taken for a table, and no failure is kept."""
    class Session:
        def __init__(self, builder):
            text = type("text", (), {"SpoofChecker": type("SpoofChecker", (), {"Builder": builder})})
            self._jvm = type("jvm", (), {"com": type("com", (), {"ibm": type("ibm", (), {"icu": type("icu", (), {"text": text})})})})

    class Short:
        build = getSkeleton = lambda self, *text: "a" if text else self

    for session in (Session(None), Session(Short), Session(None)):
        with pytest.raises(RuntimeError, match="look-alikes"):
            skeleton.confusables(session)
    assert len(skeleton.confusables(spark)) > 10_000


def test_odd_values_with_clashing_columns(spark):
    rows = [("1", "Ａ", None, "x"), ("1", "Ａ", None, "y"), ("2", "plain", "", "z"), ("3", None, "a b", None)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, form string")
    got = {(r.entity_id, r.field, r.form) for r in skeleton.odd_values(df, "entity_id", ["business_name", "business_address"]).collect()}
    assert got == {("1", "business_name", "A"), ("3", "business_address", "a b")}
    g = skeleton.groups(df.union(spark.createDataFrame([("4", "A", None, "")], df.schema)), "entity_id", ["business_name"]).collect()
    assert [(r.skeleton, r.n_forms, r.n_rows) for r in g] == [("A", 2, 3)]
    assert skeleton.odd_values(df.limit(0), "entity_id", ["business_name"]).count() == 0


# ---- top n


def test_merge_against_sort():
    rng = random.Random(3)
    for _ in range(200):
        items = [(-round(rng.random(), 1), f"c{rng.randrange(12)}") for _ in range(rng.randrange(1, 40))]
        k = rng.randrange(1, 6)
        runs = [sorted(items[i::k]) for i in range(k) if items[i::k]]
        expected, seen = [], set()
        for x in sorted(items):
            if x[1] not in seen:
                seen.add(x[1])
                expected.append(x)
        assert topn.merge(runs, 5) == expected[:5]


@pytest.mark.parametrize("fan_in", [2, 512])
def test_top_n_against_brute_force(spark, fan_in):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", f"c{rng.randrange(60)}", rng.choice([None, float("nan"), -1.0, 0.0, -0.0, 0.5, rng.random()]), 1) for _ in range(3000)]
    rows += [(None, "c", 1.0, 1), ("g", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, item string, score double, rank int").repartition(9)
    got = {}
    for r in topn.top_n(df, "g", "item", "score", 4, fan_in).collect():
        got.setdefault(r.g, {})[r.rank] = (r.item, r.score)
    best: dict = {}
    for g, i, s, _ in rows:
        if g is not None and i is not None and s is not None and s == s:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, s))
    for g, items in best.items():
        order = sorted(items.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert [got[g][k] for k in range(len(order))] == order
    assert set(got) == set(best)
    assert topn.top_n(df.limit(0), "g", "item", "score").count() == 0


# ---- encoding


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return bpe.load(), t


def test_encoder_against_library(encoders):
    ours, library = encoders
    rng = random.Random(5)
    words = ["ab", "aaaa", "  ", "\n", " the", "　", "\xa0", "é", "中文", "​", "'s", "!!!", "1234", "\t", "\r\n", "x" * 60, "<|endoftext|>", "zzzzq", "\x85", "\x1c"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(32, 127), rng.randrange(160, 0x3000)])) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ours.encode(text)
        assert ids == expected.ids
        assert ours.decode(ids).decode() == text


def test_encode_column(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5), (4, "ab" * 50_000, 5)], "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in bpe.encode(df).collect()]
    assert [x for x in got if x[0] < 4] == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {1: "", 2: "", 3: "hello world", 4: "ab" * 50_000}
    assert bpe.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(df).collect()}[3] == 2


# ---- packing


def least_bins(sizes, capacity):
    best = [len(sizes)]
    rooms: list[int] = []

    def place(i):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                place(i + 1)
                rooms[k] += sizes[i]
        rooms.append(capacity - sizes[i])
        place(i + 1)
        rooms.pop()

    place(0)
    return best[0] if sizes else 0


def test_packing_against_brute_force():
    rng, more = random.Random(6), 0
    for _ in range(150):
        sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        bins = packing.pack_block(sizes, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 20 for b in bins)
        more += len(bins) - least_bins(sizes, 20)
    assert more == 0


def test_exact_packing_against_brute_force():
    """Without bounds on the search the bins are the fewest there are, also where sizes are over an eighth of the capacity."""
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([20, 50, 100])
        sizes = sorted((rng.randrange(capacity // 8, capacity * 3 // 4) for _ in range(rng.randrange(1, 9))), reverse=True)
        assert len(packing.pack_block(sizes, capacity, exact=True)) == least_bins_of(sizes, capacity)


def least_bins_of(sizes, capacity):
    best = len(sizes)
    todo = [(0, ())]
    while todo:
        i, rooms = todo.pop()
        if len(rooms) >= best and i < len(sizes):
            continue
        if i == len(sizes):
            best = min(best, len(rooms))
            continue
        todo += [(i + 1, tuple(sorted((*rooms[:k], r - sizes[i], *rooms[k + 1 :])))) for k, r in enumerate(rooms) if r >= sizes[i]]
        todo.append((i + 1, (*rooms, capacity - sizes[i])))
    return best


def test_dominated_fillings_are_left_out():
    assert packing.dominated([3, 2], 1, [6]) and packing.dominated([3], 2, [1]) and not packing.dominated([3, 2], 0, [5]) and not packing.dominated([4], 1, [3, 6])
    found = packing.completions([7, 5, 4, 2], [1, 1, 1, 2], 1, 10, 10, None, None)
    assert [w for w, _ in found] == sorted(w for w, _ in found) and found[0][0] == 1


def test_fill_reaches_the_bound_in_many_blocks(spark):
    rng = random.Random(3)
    rows = [(i, min(5000, max(1, int(rng.lognormvariate(5.5, 1.1))))) for i in range(30_000)]
    out = packing.fill(spark.createDataFrame(rows, "doc_id long, tokens int").repartition(6), [(1, 512), (2, 2048)])
    for r in out.groupBy("limit_id", "capacity").agg(F.count_distinct("container_id").alias("n"), F.sum("tokens").alias("t")).collect():
        assert r.t == sum(t for _, t in rows) and r.n <= 1.002 * -(-r.t // r.capacity) + 1


def test_fill_is_whole(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 0, 1, 99, 100, 101, 250, rng.randrange(1, 100)])) for i in range(500)]
    out = packing.fill(spark.createDataFrame(rows, "doc_id long, tokens int").repartition(5), [(1, 100), (2, 300)]).collect()
    for limit, capacity in ((1, 100), (2, 300)):
        mine = [r for r in out if r.limit_id == limit]
        fill, parts = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append(r.tokens)
        assert max(fill.values()) <= capacity
        assert {d: sum(p) for d, p in parts.items()} == {d: t or 0 for d, t in rows}
        assert all(len(p) == 1 for d, p in parts.items() if (rows[d][1] or 0) <= capacity)
    assert packing.fill(spark.createDataFrame([], "doc_id long, tokens int"), [(1, 100)]).count() == 0


# ---- truncation


def test_strict_prefixes_against_brute_force(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice("ab\n") for _ in range(rng.randrange(1, 7))), rng.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "value string, whole boolean")
    values, ends, whole = {v for v, _ in rows}, {v for v, w in rows if not w}, {v for v, w in rows if w}
    expected = {truncation.digest(v): v in whole for v in ends if any(w != v and w.startswith(v) for w in values)}
    for partitions in (1, 6, 40):
        got = truncation.strict_prefixes(df, partitions).collect()
        assert {r.h: r.whole for r in got} == expected and len(got) == len(expected)


def test_diff_syntax():
    whole = "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
    assert not truncation.diff_open(whole) and not truncation.diff_open(whole.rstrip("\n"))
    for n in range(11, 70):
        assert truncation.diff_open(whole[:n]), whole[:n]
    assert truncation.broken_tail("Fix it\n\ndiff --g") and truncation.broken_tail("Fix it\n---\n\ndi") and not truncation.broken_tail("Fix it")
    assert truncation.diff_open(whole + "diff --gi") and not truncation.diff_open(whole + "-- \nend")
    assert not truncation.diff_open("diff --git a/x b/x\nindex 1..2\nBinary files a/x and b/x differ")


def test_truncated_reasons(spark):
    body = "Fix it\n\nThe old behaviour stays available through a setting. We noticed the problem"
    rows = [(1, body + " while testing.", "s", "c1"), (2, body[:60], "t", "c1"), (3, None, "s", "c2"), (4, "", "s", "c3"), (5, " \n", None, None), (6, "Whole text without an end…", None, "c4"), (7, "Refs: 12ab", "s", "c5")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, commit_sha string")
    got = {(r.doc_id, r.reason) for r in truncation.truncated(df, 4).collect()}
    assert (2, "prefix") in got and (7, "syntax") in got and {d for d, _ in got} == {2, 7}
    assert truncation.truncated(df.limit(0), 4).count() == 0
    assert {r.source: r.n_truncated for r in truncation.shares(df).collect()} == {"s": 1, "t": 1, None: 0}


def test_truncated_by_parts_of_other_texts(spark):
    """Sentences, words and lines of other commits tell a cut text; null commits are compared with each other."""
    whole = ["Fix queue\n\nCallers of the reader must pass the limit explicitly.", "Add cache\n\nThe command line client stays as it is.", "Ends with an ellipsis\n\nSo be it…", "Fix queue reader"]
    diff = "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,1 +1,2 @@\n a\n+    return reader_limit(7)\n"
    cut = ["New\n\nCallers of the reader must pass the lim", "New\n\nIt was tried in the comma", "New\n\nCallers of the reader must pass the lim…", "New\n\n" + diff.replace("+1,2", "+1,9")[:-6]]
    rows = [(i, t, "s", f"c{i}") for i, t in enumerate([*whole, "Old\n\n" + diff])] + [(10 + i, t, "s", f"d{i}") for i, t in enumerate(cut)]
    rows += [(20, "A message without commit\n\nThat goes on and on and on", "s", None), (21, "A message without commit\n\nThat goes on and o", "s", None), (22, None, None, None), (23, "", "s", None)]
    rows += [(30, "Fix the cache\n\nIt is whole.", "s", "t"), (31, "Fix the cache\n\nIt is whole.\n\nReviewed-by: A B <a@b.example>", "s", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, commit_sha string").withColumn("follows", F.lit("clash"))
    got = {}
    for r in truncation.truncated(df, 4).collect():
        got.setdefault(r.doc_id, set()).add(r.reason)
    assert set(got) == {10, 11, 12, 13, 21}  # 30 only lacks a trailer
    assert "fragment" in got[10] and "word" in got[11] and "fragment" in got[12] and {"fragment", "syntax"} <= got[13] and "prefix" in got[21]


def test_limits_follow_texts_found_cut(spark):
    """Where nearly all texts of a length are cut, all are; a byte limit counts beside one in characters."""
    begun = "Fix\n\nRefs: "
    rows = [(i, begun + f"{i:x}" * 20, "s", f"c{i}") for i in range(8)] + [(9, begun.replace("Refs: ", "Whole ") + "b" * 20, "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, commit_sha string")
    got = {r.doc_id for r in truncation.truncated(df, 4).filter("reason = 'limit'").collect()}
    assert got == set(range(8)) | {9}
    accents = [(i, "\u00e9" * i + "\n\nRefs: " + "a" * (38 - 2 * i), "s", f"c{i}") for i in range(6)] + [(7, "Whole" + "\u20ac" * 14, "s", "z")]
    df = spark.createDataFrame(accents, "doc_id long, text string, source string, commit_sha string")
    assert {r.doc_id for r in truncation.truncated(df, 4).filter("reason = 'limit'").collect()} == {0, 1, 2, 3, 4, 5, 7}
