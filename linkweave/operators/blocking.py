"""Candidate pairs from shared keys: capped and masked joins, lexical blocking, TF-IDF name search, provenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions import text as T


def tokens(df: DataFrame, column: str = "business_name") -> DataFrame:
    """``(entity_id, country, tok)``: distinct lower-case words of each record."""
    return df.select("entity_id", "country", F.explode(F.array_distinct(F.split(F.lower(column), " "))).alias("tok"))


def idf(toks: DataFrame, sizes: DataFrame) -> DataFrame:
    """``ln((n + 1) / (df + 1)) + 1`` of each word per country; ``sizes`` is (country, n)."""
    df = toks.groupBy("country", "tok").agg(F.count("*").alias("df"))
    return df.join(sizes, "country").withColumn("idf", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1)


def stop_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """``(country, key)`` that over ``most`` records hold."""
    return df.filter(F.col(key).isNotNull()).groupBy("country", key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select("country", key)


def mask_stops(df: DataFrame, stops: DataFrame, key: str) -> DataFrame:
    """Stop keys become null, so they never join; the records stay. A key that is rare is not looked at twice."""
    hit = df.join(stops.withColumn("_stop", F.lit(True)), ["country", key], "left")
    return hit.withColumn(key, F.when(F.col("_stop").isNull(), F.col(key))).drop("_stop")


def capped_join(left: DataFrame, right: DataFrame, on: list[str], cap: int) -> DataFrame:
    """``(s1, cand)`` that share a key which at most ``cap`` candidates hold; null keys never join."""
    ok = right.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") <= cap).select(*on)
    b = right.join(ok, on, "left_semi").withColumnRenamed("entity_id", "cand")
    return left.withColumnRenamed("entity_id", "s1").join(b, on).select("s1", "cand")


#: Priority of each lexical key; a lower one is more telling.
PRIORITY = {"pin": 0, "hnum": 1, "first_tok": 2, "tok": 2, "nprefix": 3, "phon": 3}


def lexical_pairs(left: DataFrame, right: DataFrame, most: int = 2000, keys: tuple[str, ...] = tuple(PRIORITY)) -> DataFrame:
    """``(s1, cand, nkeys, best_prio)`` of records of one country that share a lexical key.

    One exploded key column and one equi-join serve all keys, so both sides are shuffled once. A key that over ``most``
    records of the right side hold is a stop key and joins nothing. Word hits count once per shared word.
    """
    a, b = _long_keys(left, keys, "s1"), _long_keys(right, keys, "cand")
    stops = b.groupBy("country", "k").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("country", "k")
    hits = a.join(stops, ["country", "k"], "left_anti").join(b.drop("prio"), ["country", "k"])
    return hits.groupBy("s1", "cand").agg(F.count("*").alias("nkeys"), F.min("prio").alias("best_prio"))


def _long_keys(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    x = T.with_keys(df)
    arms = [F.struct(F.concat(F.lit(f"{k}:"), F.col(k)).alias("k"), F.lit(PRIORITY[k]).alias("prio")) for k in keys if k != "tok"]
    rows = x.select(F.col("entity_id").alias(name), "country", F.explode(F.array(*arms)).alias("e"))
    rows = rows.select(name, "country", "e.k", "e.prio").filter("k IS NOT NULL")
    if "tok" in keys:
        toks = F.explode(F.filter(F.split("name_clean", " "), lambda w: F.length(w) >= 4)).alias("t")
        words = x.select(F.col("entity_id").alias(name), "country", toks).select(name, "country", F.concat(F.lit("tok:"), F.col("t")).alias("k"), F.lit(PRIORITY["tok"]).alias("prio"))
        rows = rows.unionByName(words)
    return rows


def lexical_block(left: DataFrame, right: DataFrame, cap: int = 30, most: int = 2000, block: int = 8192) -> DataFrame:
    """``(s1, cand, nkeys, best_prio)``: the ``cap`` candidates of each record that share the most keys; ties: better priority, then smaller id.

    The same pairs as the head of ``lexical_pairs``, but pairs are never rows: blocks of records hold posting lists, and
    each record's hits are counted in an array, as in ``sparse_top``. Stop keys join nothing.
    """
    a, b = _long_keys(left, tuple(PRIORITY), "entity_id"), _long_keys(right, tuple(PRIORITY), "entity_id")
    stops = b.groupBy("country", "k").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("country", "k")
    vector = lambda x: x.join(stops, ["country", "k"], "left_anti").groupBy("country", "entity_id").agg(F.collect_list(F.xxhash64("k")).alias("g"), F.collect_list(F.col("prio").cast("double")).alias("w"))
    found = _in_blocks(vector(a), vector(b), right, block).mapInPandas(_searcher(lambda: _SharedKeys(cap)), "s1 string, cand string, nkeys bigint, best_prio int")
    w = Window.partitionBy("s1").orderBy(F.desc("nkeys"), "best_prio", "cand")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).drop("n")


def by_country(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(s1, cand)`` on a key within the country; records of a country the right side lacks meet it in all countries."""
    known = right.select("country").distinct()
    a, b = left.withColumnRenamed("entity_id", "s1"), right.withColumnRenamed("entity_id", "cand")
    within = a.join(b, ["country", key]).select("s1", "cand")
    anywhere = a.join(known, "country", "left_anti").join(b.drop("country"), key).select("s1", "cand")
    return within.unionByName(anywhere)


def grams(df: DataFrame, text: str, n: int = 3) -> DataFrame:
    """``(entity_id, country, gram, tf)``: character n-grams of each word with a space on either side, sublinear frequency ``1 + ln tf``."""
    # Counted within the row: no shuffle is needed to see what a record holds.
    counted = df.select("entity_id", "country", _cuts(text, n).alias("all")).select("entity_id", "country", "all", F.explode(F.array_distinct("all")).alias("gram"))
    return counted.select("entity_id", "country", "gram", (1 + F.log(F.size(F.filter("all", lambda g: g == F.col("gram"))))).alias("tf"))


def _cuts(text: str, n: int) -> Column:
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (n - 1))), lambda i: w.substr(i, F.lit(n)))))


def tfidf(left: DataFrame, right: DataFrame, text: str, min_df: int = 2, max_df: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Unit TF-IDF vectors ``(entity_id, country, gram, w)`` of both sides, with smooth idf and grams from ``min_df`` records to ``max_df`` of all.

    Each country has its own vocabulary, of the records of both sides. A null text has no grams.
    """
    a, b = grams(left, text), grams(right, text)
    n = left.select("country").unionAll(right.select("country")).groupBy("country").agg(F.count("*").alias("n"))
    df = a.select("country", "gram").unionAll(b.select("country", "gram")).groupBy("country", "gram").agg(F.count("*").alias("df"))
    vocab = df.join(n, "country").filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    vocab = vocab.select("country", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def unit(x: DataFrame) -> DataFrame:
        y = x.join(vocab, ["country", "gram"]).withColumn("w", F.col("tf") * F.col("idf"))
        return y.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("entity_id")))).select("entity_id", "country", "gram", "w")

    return unit(a), unit(b)


#: Records that one block of a sparse search holds.
SPARSE_BLOCK = 8192


def sparse_top(a: DataFrame, b: DataFrame, k: int, least: float = 0.0, block: int = SPARSE_BLOCK) -> DataFrame:
    """``(s1, cand, sim, r)``: the k most similar records of one country by dot product over shared grams, over ``least``; ties by smaller id.

    ``a`` and ``b``: vectors (entity_id, country, gram, w). The product is taken in blocks: a block holds the posting lists
    of about ``block`` records of ``b``, each record of ``a`` goes once to each block of its country and gets k records
    back. What is shuffled is records times blocks; the hits of a common gram meet inside a task, as sums in an array,
    and are never rows, so a posting list that grows with the data costs no shuffle.
    """
    vector = lambda x: x.groupBy("country", "entity_id").agg(F.collect_list(F.xxhash64("gram")).alias("g"), F.collect_list("w").alias("w"))
    found = _in_blocks(vector(a), vector(b), b, block).mapInPandas(_searcher(lambda: _Products(k, least)), "s1 string, cand string, sim double")
    n = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("sim"), "cand"))
    return found.withColumn("n", n).filter(F.col("n") <= k).select("s1", "cand", "sim", (F.col("n") - 1).alias("r"))


#: Asking texts that one task of a text search answers, records that ask by them, parts that a country has at least, and held texts that meet them at once.
ASKING, ASKERS, PARTS, HELD = 131_072, 1_048_576, 6, 131_072


def text_top(left: DataFrame, right: DataFrame, text: str, k: int, held: int = HELD) -> DataFrame:
    """``(s1, cand, sim, r)``: the k records of ``right`` in the country whose unit TF-IDF vectors have the highest dot product; ties by smaller id.

    The same as ``sparse_top`` of ``tfidf`` of both sides, but what is shuffled are texts, never vectors or answers, and
    texts of the same words are searched once, however many records have them. Rows of one id and country are one text.
    """
    a, b = _documents(left, text), _documents(right, text)
    vocab = _vocabulary(left, right, a, b)
    a, b = (_foreign_mass(x, vocab).withColumnRenamed("mass", "x") for x in (a, b))
    return passing_by(a, b, k, _TextSearch, "sim double", vocab.select("country", F.col("gram").alias("text"), F.col("idf").alias("x")), held)


def passing_by(a: DataFrame, b: DataFrame, k: int, search, values: str, first: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """``(s1, cand, <values>, r)``: the k records of ``b`` that are the best for each of ``a``, both (entity_id, country, text, x), by country.

    Each asking text is in one task, to which the country's rows of ``first`` (text, x) and the texts of ``b`` come in order
    of their smallest id. The task keeps the k best of its texts while the others pass by in runs of ``held``. Records of
    equal text and x are as good, so a text comes once, with its k smallest ids; no more of them can be among the best.
    ``search``: made of the rows of ``first`` and the asking texts, see ``_Best``.
    """
    same = ["country", "text", "x"]
    n = F.row_number().over(Window.partitionBy(*same).orderBy("entity_id"))
    b = b.withColumn("n", n).filter(F.col("n") <= k).groupBy(*same).agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))
    texts, rows = F.approx_count_distinct("text"), F.count("*")
    parts = F.greatest(F.ceil(texts / ASKING), F.ceil(rows / ASKERS), F.least(F.lit(PARTS), F.ceil(rows / 1024))).cast("int")
    sizes = a.groupBy("country").agg(parts.alias("parts"))
    sizes = sizes.withColumn("before", F.sum("parts").over(Window.orderBy("country")) - F.col("parts"))
    every, ids = F.explode(F.expr("sequence(0, parts - 1)")), F.col("ids")
    row = lambda x, part, o, ids: x.join(sizes, "country").select("country", "before", part.alias("part"), F.lit(o).alias("o"), ids.alias("ids"), "text", "x")
    rows = row(a, F.expr("cast(pmod(xxhash64(text), parts) as int)"), 1, F.array("entity_id")).unionByName(row(b, every, 2, ids))
    if first is not None:
        rows = rows.unionByName(row(first, every, 0, F.lit(None).cast("array<string>")))
    tasks = max(1, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionById(tasks, F.expr(f"cast(pmod(before + part, {tasks}) as int)")).drop("before").sortWithinPartitions("country", "part", "o", "ids")
    names = [v.split()[0] for v in values.split(", ")]
    return rows.mapInPandas(_passing_by(search, k, held, names), f"s1 string, cand string, {values}, r int")


def _documents(df: DataFrame, text: str) -> DataFrame:
    """``(entity_id, country, text, abroad)``: sorted lower-case words of all rows of an id in a country; abroad: whether it has other countries too."""
    x = df.filter(F.col(text).isNotNull() & F.col("country").isNotNull()).select("entity_id", "country", F.regexp_replace(F.lower(text), r"\s+", " ").alias("t"))
    one = x.groupBy("entity_id").agg(F.collect_list(F.struct("country", "t")).alias("all"))
    one = one.select("entity_id", "all", F.array_distinct(F.transform("all", lambda e: e["country"])).alias("countries"))
    one = one.select("entity_id", "all", (F.size("countries") > 1).alias("abroad"), F.explode("countries").alias("country"))
    mine = F.transform(F.filter("all", lambda e: e["country"] == F.col("country")), lambda e: e["t"])
    words = F.array_sort(F.filter(F.split(F.array_join(mine, " "), " "), lambda w: w != ""))
    return one.select("entity_id", "country", F.array_join(words, " ").alias("text"), "abroad")


def _vocabulary(left: DataFrame, right: DataFrame, a: DataFrame, b: DataFrame, min_df: int = 2, max_df: float = 0.02) -> DataFrame:
    """``(country, gram, idf)`` of the grams from ``min_df`` documents of both sides to ``max_df`` of their records."""
    n = left.select("country").unionAll(right.select("country")).groupBy("country").agg(F.count("*").alias("n"))
    texts = a.unionAll(b).groupBy("country", "text").agg(F.count("*").alias("docs"))
    df = texts.select("country", "docs", F.explode(F.array_distinct(_cuts("text", 3))).alias("gram")).groupBy("country", "gram").agg(F.sum("docs").alias("df"))
    vocab = df.join(n, "country").filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    return vocab.select("country", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _foreign_mass(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``mass``: squared length of an id's vector in its other countries, 0 for nearly all: a unit vector is one over all of them."""
    g = grams(docs.filter("abroad"), "text").join(vocab, ["country", "gram"]).groupBy("entity_id", "country").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("own"))
    whole = g.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("country", "own"))).alias("of"))
    rest = F.aggregate(F.map_values(F.map_filter("of", lambda c, _: c != F.col("country"))), F.lit(0.0), lambda s, m: s + m)
    return docs.join(whole, "entity_id", "left").select("entity_id", "country", "text", F.coalesce(rest, F.lit(0.0)).alias("mass"))


class _Vectors:
    """Unit vectors of texts, one after the other: ``begin`` of each, grams by number, weights."""

    def __init__(self, vocab: dict[str, int], idf: np.ndarray, texts: list[str], mass: np.ndarray):
        words: dict[str, list[int]] = {}
        flat: list[int] = []
        sizes = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(flat)
            for w in text.split(" "):
                if w:
                    if (of := words.get(w)) is None:
                        padded = f" {w} "
                        of = words[w] = [x for j in range(len(w)) if (x := vocab.get(padded[j : j + 3])) is not None]
                    flat += of
            sizes[i] = len(flat) - before
        key, count = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(idf) + np.array(flat, np.int64), return_counts=True)
        row, self.gram = np.divmod(key, len(idf))
        self.weight = (1 + np.log(count)) * idf[self.gram]
        self.weight /= np.sqrt(np.bincount(row, self.weight**2, len(texts)) + mass)[row]
        self.row, self.begin = row, np.searchsorted(row, np.arange(len(texts) + 1))


class _TextBlock:
    """A run of held records: vectors, and the posting list of each gram with its greatest weight."""

    def __init__(self, v: _Vectors, grams: int):
        order = np.argsort(v.gram, kind="stable")
        self.v, self.place, self.weight = v, v.row[order], v.weight[order]
        self.begin = np.searchsorted(v.gram[order], np.arange(grams + 1))
        self.most = np.zeros(grams)
        np.maximum.at(self.most, v.gram, v.weight)
        self.asked = np.zeros(grams)

    def exact(self, some: np.ndarray) -> np.ndarray:
        """Dot products of the asker (its weights are in ``asked``) with some places, rounded."""
        lo, n = self.v.begin[some], self.v.begin[some + 1] - self.v.begin[some]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(lo - ends + n, n)
        return np.round(np.bincount(np.repeat(np.arange(len(some)), n), self.asked[self.v.gram[at]] * self.v.weight[at], len(some)), 6)

    def best(self, gram: np.ndarray, weight: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and products of the k best of the run that are over ``least`` (of equals the first), best first.

        Lists that together could not lift a record over the k best so far are not walked: only records of the others are
        candidates, and what candidates have in all lists is then summed.
        """
        lo, hi = self.begin[gram], self.begin[gram + 1]
        told = hi > lo
        gram, weight, lo, hi = gram[told], weight[told], lo[told], hi[told]
        if not len(gram):
            return np.empty(0, np.int64), np.empty(0)
        self.asked[gram] = weight
        order = np.argsort(hi - lo, kind="stable")
        lo, hi, weight, bound = lo[order], hi[order], weight[order], (weight * self.most[gram])[order]
        walked = np.cumsum(hi - lo)
        if least < 0 and len(order) > 1:
            # The k-th of some records that share rare grams is a floor for the k-th of all.
            first = max(1, int(np.searchsorted(walked, 4 * LEAST_WALK)))
            where, product = self._entries(lo[:first], hi[:first], weight[:first])
            some, at = np.unique(where, return_inverse=True)
            part = np.bincount(at, product)
            if len(some) > 8 * k:
                some = some[np.argpartition(-part, 8 * k)[: 8 * k]]
            if len(some) >= k:
                # A record that equals the floor may still be first by its id.
                least = float(np.partition(self.exact(some), len(some) - k)[len(some) - k]) - 1e-6
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        use = max(1, int(np.argmax(rest <= least - 2e-6))) if least > 2e-6 else len(order)
        some = np.flatnonzero(np.bincount(*self._entries(lo[:use], hi[:use], weight[:use])) > max(0.0, least - 1e-6 - rest[use]))
        sims = self.exact(some) if len(some) else np.empty(0)
        self.asked[gram] = 0
        some, sims = some[sims > least], sims[sims > least]
        if len(some) > k:
            keep = sims >= np.partition(sims, len(sims) - k)[len(sims) - k]
            some, sims = some[keep], sims[keep]
        top = np.lexsort((some, -sims))[:k]
        return some[top], sims[top]

    def _entries(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in some lists, and their products."""
        spans = list(zip(lo.tolist(), hi.tolist(), strict=True))
        return np.concatenate([self.place[x:y] for x, y in spans]), np.concatenate([self.weight[x:y] for x, y in spans]) * np.repeat(weight, hi - lo)


#: Entries of the shortest lists that are walked first, for a floor.
LEAST_WALK = 500


class _Best:
    """The best so far of each asking text: ``ids`` and ``sims`` of texts, the best first; of equals those that came first."""

    def __init__(self, texts: int):
        self.found: list[tuple[list, np.ndarray]] = [([], np.empty(0)) for _ in range(texts)]

    def answers(self, i: int, k: int) -> list[tuple]:
        """``(id, value, ...)`` of the k best records of asking text i."""
        names, sims = self.found[i]
        pairs = [(c, s) for ids, s in zip(names, sims.tolist(), strict=True) for c in ids]
        return sorted(pairs, key=lambda e: (-e[1], e[0]))[:k]


class _TextSearch(_Best):
    """Searches by unit TF-IDF vectors; ``first`` is the vocabulary, x of a text its mass."""

    def __init__(self, first: pd.DataFrame, texts: list[str], mass: np.ndarray, country: str, k: int):
        super().__init__(len(texts))
        self.vocab, self.idf, self.k = {g: i for i, g in enumerate(first.text)}, first.x.to_numpy(float), k
        self.asked = _Vectors(self.vocab, self.idf, texts, mass) if len(first) else None

    def meet(self, texts: list[str], mass: np.ndarray, ids: np.ndarray) -> None:
        if not (v := self.asked):
            return
        block, k = _TextBlock(_Vectors(self.vocab, self.idf, texts, mass), len(self.idf)), self.k
        for i, (names, sims) in enumerate(self.found):
            lo, hi = v.begin[i], v.begin[i + 1]
            some, new = block.best(v.gram[lo:hi], v.weight[lo:hi], k, sims[-1] if len(sims) == k else -1.0)
            if len(some):
                # Earlier runs have the smaller ids, so of equals they stay first.
                both, all_names = np.append(sims, new), names + ids[some].tolist()
                order = np.argsort(-both, kind="stable")[:k]
                self.found[i] = [all_names[j] for j in order], both[order]


def _passing_by(search, k: int, held: int, values: list[str]):
    """Answers the asking rows (o = 1) of each country and part from the held ones (o = 2), by the rows before them (o = 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, rows = None, {}

        def meet() -> None:
            """Lets the waiting held rows pass the askers."""
            if "best" not in rows and 1 in rows:
                a = pd.concat(rows.pop(1))
                rows["ids"], rows["at"] = a.ids.str[0].to_numpy(), a.groupby(["text", "x"], sort=False).ngroup().to_numpy()
                one = a.drop_duplicates(["text", "x"])
                first = pd.concat(rows.pop(0)) if 0 in rows else one.head(0)
                rows["best"] = search(first, one.text.tolist(), one.x.to_numpy(float), of[0], k)
            if "best" in rows and rows.get(2):
                h = pd.concat(rows[2])
                rows["best"].meet(h.text.tolist(), h.x.to_numpy(float), h.ids.to_numpy())
            rows[2] = []

        def answer() -> Iterator[pd.DataFrame]:
            meet()
            if "best" not in rows:
                return
            order = np.argsort(rows["at"], kind="stable")
            names, at = rows["ids"][order], rows["at"][order]
            out, last, said = [], -1, []
            for s1, i in zip(names, at, strict=True):
                if i != last:
                    last, said = i, [(*v, r) for r, v in enumerate(rows["best"].answers(i, k))]
                out += [(s1, *v) for v in said]
                if len(out) >= 100_000:
                    yield pd.DataFrame(out, columns=["s1", "cand", *values, "r"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["s1", "cand", *values, "r"])

        for df in batches:
            for key, part in df.groupby(["country", "part"], sort=False):
                if key != of:
                    yield from answer()
                    of, rows = key, {}
                for o, some in part.groupby("o", sort=True):
                    rows.setdefault(int(o), []).append(some)
                if sum(map(len, rows.get(2, []))) >= held:
                    meet()
        yield from answer()

    return run


def _in_blocks(asked: DataFrame, held: DataFrame, sizes_of: DataFrame, block: int) -> DataFrame:
    """Rows (country, entity_id, g, w) of both sides by country and block: a held one (t = 0) in one block, an asked one (t = 1) in all."""
    sizes = sizes_of.groupBy("country").agg(F.ceil(F.approx_count_distinct("entity_id") / block).cast("int").alias("blocks"))
    mine = held.join(sizes, "country").select("country", F.expr("cast(pmod(xxhash64(entity_id), blocks) as int)").alias("b"), F.lit(0).alias("t"), "entity_id", "g", "w")
    ask = asked.join(sizes, "country").select("country", F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"), F.lit(1).alias("t"), "entity_id", "g", "w")
    tasks = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mine.unionByName(ask).repartition(tasks, "country", "b").sortWithinPartitions("country", "b", "t", "entity_id")


class _Postings:
    """Posting lists of a block: each key's places among the ids, with weights."""

    def __init__(self, parts: list[pd.DataFrame]):
        self.ids = np.concatenate([p.entity_id.to_numpy() for p in parts])
        sizes = np.concatenate([p.g.map(len).to_numpy() for p in parts])
        key, weight = (np.concatenate([x for p in parts for x in p[c]]) for c in ("g", "w"))
        order = np.argsort(key, kind="stable")
        self.known, begin = np.unique(key[order], return_index=True)
        self.begin = np.append(begin, len(key))
        self.place, self.weight = np.repeat(np.arange(len(self.ids)), sizes)[order], weight[order]

    def lists(self, keys: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
        """From, to and the asker's weight of each list that the asker's keys have here."""
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        hit = self.known[at] == keys
        return [(self.begin[i], self.begin[i + 1], x) for i, x in zip(at[hit], weights[hit], strict=True)]


class _Products:
    """The k greatest dot products over ``least``; of equals the first ids."""

    names = ("sim",)

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least

    def best(self, p: _Postings, lists: list[tuple[int, int, float]]) -> tuple[np.ndarray, list]:
        where = np.concatenate([p.place[lo:hi] for lo, hi, _ in lists])
        total = np.round(np.bincount(where, np.concatenate([p.weight[lo:hi] * x for lo, hi, x in lists])), 6)
        some = np.unique(where)
        some = some[total[some] > self.least] if self.least else some
        if len(some) > self.k:
            some = some[total[some] >= -np.partition(-total[some], self.k - 1)[self.k - 1]]
        some = some[np.lexsort((some, -total[some]))][: self.k]
        return some, [total[some]]


class _SharedKeys:
    """The k records that share the most keys; of equals those of the better (smaller) priority, then the first ids."""

    names = ("nkeys", "best_prio")

    def __init__(self, k: int):
        self.k = k

    def best(self, p: _Postings, lists: list[tuple[int, int, float]]) -> tuple[np.ndarray, list]:
        where = np.concatenate([p.place[lo:hi] for lo, hi, _ in lists])
        total = np.bincount(where)
        some = np.flatnonzero(total)
        if len(some) > self.k:
            some = some[total[some] >= -np.partition(-total[some], self.k - 1)[self.k - 1]]
        prio = np.empty(len(total), np.int32)
        for lo, hi, x in sorted(lists, key=lambda e: -e[2]):
            prio[p.place[lo:hi]] = x
        some = some[np.lexsort((some, prio[some], -total[some]))][: self.k]
        return some, [total[some], prio[some]]


def _searcher(make):
    """Answers each asked row (t = 1) of a block from the held ones (t = 0), which come first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = make()
        of, parts, held = None, [], None
        for df in batches:
            for key, part in df.groupby(["country", "b"], sort=False):
                if key != of:
                    of, parts, held = key, [], None
                if len(mine := part[part.t == 0]):
                    parts.append(mine)
                if not len(asked := part[part.t == 1]) or not parts:
                    continue
                held = held or _Postings(parts)
                q, c, values = [], [], [[] for _ in search.names]
                for name, keys, w in zip(asked.entity_id, asked.g, asked.w, strict=True):
                    if lists := held.lists(keys, w):
                        # Ids are ascending: of equals the first places have the smaller ones.
                        some, found = search.best(held, lists)
                        q += [name] * len(some)
                        c.append(held.ids[some])
                        for column, v in zip(values, found, strict=True):
                            column.append(v)
                if q:
                    yield pd.DataFrame({"s1": q, "cand": np.concatenate(c)} | {n: np.concatenate(v) for n, v in zip(search.names, values, strict=True)})

    return run


def union_searches(searches: dict[str, DataFrame]) -> DataFrame:
    """Every pair of any search once, with its rank in each (null where a search did not find it). Searches: (s1, cand, r)."""
    rows = None
    for name, s in searches.items():
        x = s.select("s1", "cand", F.lit(name).alias("search"), "r")
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy("s1", "cand").agg(*[F.min(F.when(F.col("search") == n, F.col("r"))).alias(f"{n}_rank") for n in searches])
