import random

from hypothesis import given, settings
from hypothesis import strategies as st

from linkweave.functions import ratios as R
from linkweave.functions import similarity as S

words = st.text("abcdef ", max_size=14)


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
    return row[-1]


def naive_partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0
    windows = [b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))]
    return max(200 * naive_lcs(a, w) / (len(a) + len(w)) for w in windows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), max_size=12))
def test_many_ratios_against_naive(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert R.lcs_many(a, b).tolist() == [naive_lcs(x, y) for x, y in pairs]
    assert R.partial_many(a, b).round(6).tolist() == [round(naive_partial(x, y), 6) for x, y in pairs]


def test_ratios_over_word_borders():
    """Texts around 64 and 128 letters take one, two and three machine words; very long ones go one by one."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    sizes = [1, 63, 64, 65, 127, 128, 129, 200]
    a, b = [text(m) for m in sizes for _ in sizes], [text(n) for _ in sizes for n in sizes]
    assert R.lcs_many(a, b).tolist() == [naive_lcs(x, y) for x, y in zip(a, b, strict=True)]
    few = [i for i in range(len(a)) if len(a[i]) + len(b[i]) < 200]
    assert R.partial_many([a[i] for i in few], [b[i] for i in few]).round(6).tolist() == [round(naive_partial(a[i], b[i]), 6) for i in few]
    long = text(3000)
    assert R.lcs_many([long, "\0a"], [long[5:], "\0b"]).tolist() == [2995, 1] and R.partial_many([long[100:1300]], [long])[0] == 100


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_ratio_bounds(a, b):
    assert 0 <= S.ratio(a, b) <= 100 and S.ratio(a, b) == S.ratio(b, a) and S.ratio(a, a) == 100
    assert S.partial_ratio(a, b) >= 0 and (not a or S.partial_ratio(a, f"x{a}y") == 100)
    assert 0 <= S.jaro_winkler(a, b) <= 1


def test_token_ratios():
    assert S.token_sort_ratio("b a", "a b") == 100
    assert S.token_set_ratio("new york mets", "mets new york city") == 100
    assert S.token_set_ratio("", "a") == 0
    assert round(S.token_set_ratio("fuzzy was a bear", "wuzzy fuzzy was a hare"), 4) == round(max(200 * 11 / (11 + 16), 200 * 11 / (11 + 22), 200 * naive_lcs("a fuzzy was bear", "a fuzzy was hare wuzzy") / 38), 4)
    assert round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611


def test_typo_overlap():
    assert S.idf_overlap_typo([], [], ["a"], [1.0]) is None
    j, cover, a, b = S.idf_overlap_typo(["street", "main"], [2.0, 1.0], ["stret", "main"], [5.0, 1.0])
    assert j == 1 and cover == 1 and a == 0 and b == 0
    for x, y, near in (("road", "roads", True), ("road", "rods", False), ("market", "markte", True), ("abc", "abd", False), ("colony", "colonial", False)):
        assert S._near(x, y) == near, (x, y)


def test_unknown_is_null(spark):
    df = spark.createDataFrame([("", "a"), (None, "a"), ("a", "a"), ("a", "a")], "a string, b string")
    assert [r.v for r in df.select(S.ratio_col("a", "b").alias("v")).collect()] == [None, None, 100.0, 100.0]
    assert df.limit(0).select(S.partial_col("a", "b")).count() == 0
