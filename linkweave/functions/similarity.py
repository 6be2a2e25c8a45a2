"""Pair similarity: native expressions where Spark has them, Arrow UDFs for edit-based ratios. Null means unknown: an empty side."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.functions.ratios import partial_many, ratio_many, token_set_many, token_sort_many


def ratio(a: str, b: str) -> float:
    """200 times the common subsequence over both lengths."""
    return float(ratio_many([a], [b])[0])


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer, windows at the ends included."""
    return float(partial_many([a], [b])[0])


def token_sort_ratio(a: str, b: str) -> float:
    return float(token_sort_many([a], [b])[0])


def token_set_ratio(a: str, b: str) -> float:
    """100 where words are shared and one side adds none, else the best of the shared words with either side and both sides."""
    return float(token_set_many([a], [b])[0])


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by up to four equal first letters where it is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                hits.append(ch)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if taken[j]]
    t = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def _pairwise(many):
    """A column of a function of many pairs; null where a side is null or empty. A pair that repeats in a batch is done once."""

    @F.pandas_udf(T.DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        at: dict[tuple[str, str], int] = {}
        place = [at.setdefault((x, y), len(at)) if x and y else -1 for x, y in zip(a, b, strict=True)]
        left, right = [x for x, _ in at], [y for _, y in at]
        values = np.append(np.asarray(many(left, right), float), np.nan)
        return pd.Series(values[place]) if len(place) else pd.Series([], dtype="float64")

    return udf


def _jaro_winkler_many(a: list[str], b: list[str]) -> list[float]:
    return [jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]


ratio_col, partial_col, token_sort_col, token_set_col, jaro_winkler_col = map(_pairwise, (ratio_many, partial_many, token_sort_many, token_set_many, _jaro_winkler_many))


def same(a: Column, b: Column) -> Column:
    """1 or 0; null where either is empty."""
    return F.when((a != "") & (b != ""), (a == b).cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; null if both are empty, 0 if one is."""
    return F.when((F.size(a) > 0) | (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def cover(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that ``b`` has; null if both are empty, 0 if one is."""
    n = F.size(F.array_distinct(a))
    return F.when((n > 0) | (F.size(b) > 0), F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0))


def near_word(a: Column, b: Column) -> Column:
    """A typo apart: letters only, four or more, lengths within 2, one edit where ``a`` has under six letters, else two."""
    most = F.when(F.length(a) < 6, 1).otherwise(2)
    shape = a.rlike("^[a-z]{4,}$") & b.rlike("^[a-z]{4,}$") & (F.abs(F.length(a) - F.length(b)) <= 2)
    return shape & (F.levenshtein(a, b) <= most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def centered(v: Column, mean: Column) -> Column:
    """The vector less the mean, at length one."""
    x = F.zip_with(v, mean, lambda p, q: p.cast("double") - q.cast("double"))
    n = F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    return F.transform(x, lambda p: p / n)


def idf_overlap(a: Column, b: Column, weight) -> dict[str, Column]:
    """Weighted Jaccard, weighted cover of ``a``, and the greatest weight missing on either side; null where a side is empty.

    ``weight``: a function from a word Column to its weight Column.
    """
    total = lambda x: F.aggregate(F.transform(x, weight), F.lit(0.0), lambda s, w: s + w)
    most = lambda x: F.coalesce(F.array_max(F.transform(x, weight)), F.lit(0.0))
    both, told = total(F.array_intersect(a, b)), (F.size(a) > 0) & (F.size(b) > 0)
    return {
        "jaccard": F.when(told, both / total(F.array_union(a, b))),
        "cover": F.when(told, both / total(F.array_distinct(a))),
        "miss_s1": F.when(told, most(F.array_except(a, b))),
        "miss_cand": F.when(told, most(F.array_except(b, a))),
    }


def idf_overlap_typo(a: list[str], wa: list[float], b: list[str], wb: list[float]) -> tuple[float, float, float, float] | None:
    """``idf_overlap`` where words a typo apart count as shared: heaviest word first, then alphabetical; a pair weighs the first side's weight on both."""
    x, y = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
    if not x or not y:
        return None
    shared = {w: x[w] for w in x if w in y}
    left, right = {w: v for w, v in x.items() if w not in shared}, {w: v for w, v in y.items() if w not in shared}
    for w in sorted(left, key=lambda w: (-left[w], w)):
        hit = next((v for v in sorted(right) if _near(w, v)), None)
        if hit is not None:
            shared[w] = left.pop(w)
            right.pop(hit)
    both = sum(shared.values())
    return both / (both + sum(left.values()) + sum(right.values())), both / sum(x.values()), max(left.values(), default=0.0), max(right.values(), default=0.0)


@lru_cache(maxsize=1_000_000)
def _letters(word: str) -> int:
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(maxsize=1_000_000)
def _near(a: str, b: str) -> bool:
    if len(a) < 4 or len(b) < 4 or abs(len(a) - len(b)) > 2 or not (a.isalpha() and b.isalpha()):
        return False
    # Every letter that one word lacks takes an edit.
    most, x, y = 1 if len(a) < 6 else 2, _letters(a), _letters(b)
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return False
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row = row, [i]
        for j, q in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != q)))
    return row[-1] <= most


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("jaccard", "cover", "miss_s1", "miss_cand")]))
def idf_overlap_typo_col(a: pd.Series, wa: pd.Series, b: pd.Series, wb: pd.Series) -> pd.DataFrame:
    rows = [idf_overlap_typo(list(p), list(u), list(q), list(v)) or (None,) * 4 for p, u, q, v in zip(a, wa, b, wb, strict=True)]
    return pd.DataFrame(rows, columns=["jaccard", "cover", "miss_s1", "miss_cand"], dtype="float64")
