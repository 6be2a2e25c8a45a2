"""Matching entities across sources without keys: heuristics vote, a generative label model weighs the votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm import pairs
from linkweave.llm.records import variants
from linkweave.sources.tables import cut

#: A blocking key with more clean records than HOT is joined in blocks of about so many.
HOT = 64
GROUPS = [pairs.VOTES[:4], [*pairs.VOTES[4:], "v_unique"]]
LABELERS = [v for g in GROUPS for v in g]
#: What each heuristic is taken to be before anything is learned: its share of votes that are right.
PRIOR_ACCURACY = 0.8


@F.pandas_udf(T.ArrayType(T.StringType()))
def _variants(core: pd.Series) -> pd.Series:
    return core.map(lambda c: list(variants(c)) if c else [])


def keyed(parsed: DataFrame, clean: bool) -> DataFrame:
    """``(entity_id, key)``: blocking keys of each record.

    Records of the other side use the most telling key they can: building, else street with number, else own word in the
    town, else own word in the country. The clean side has all of them. Own words come with one letter left out, so two
    words within one edit of another meet.
    """
    has = {c: F.col(c) != "" for c in ("house", "street", "core")}
    town = F.col("town").isNotNull()
    building = F.when(has["house"] & town, F.concat_ws("|", F.lit("H"), "country", "town", "house"))
    number = F.when(has["house"] & has["street"] if clean else has["house"] & has["street"] & ~town, F.concat_ws("|", F.lit("S"), "country", "street", "house"))
    in_town = town if clean else town & ~has["house"]
    nowhere = F.lit(True) if clean else ~town
    v = F.col("variants")
    n_keys = F.when(in_town, F.transform(v, lambda x: F.concat_ws("|", F.lit("N"), "country", "town", x)))
    m_keys = F.when(nowhere, F.transform(v, lambda x: F.concat_ws("|", F.lit("M"), "country", x)))
    w_keys = F.when(nowhere & (F.col("site") != ""), F.array(F.concat_ws("|", F.lit("W"), "country", "site")))
    if clean:
        cuts = F.transform(F.sequence(F.lit(8), F.greatest(F.lit(8), F.char_length("whole"))), lambda n: F.concat_ws("|", F.lit("W"), "country", F.col("whole").substr(F.lit(1), n)))
        w_keys = F.when(F.col("whole") != "", F.array_distinct(cuts))
    none = F.array().cast("array<string>")
    keys = F.concat(F.array_compact(F.array(building, number)), F.coalesce(n_keys, none), F.coalesce(m_keys, none), F.coalesce(w_keys, none))
    return parsed.withColumn("variants", _variants("core")).select("entity_id", F.explode(keys).alias("key"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``(a_id, b_id)`` of clean and other records that share a blocking key.

    All of them are kept, however many share a key: the label model and its rule for ties leave those unlinked that nothing
    tells apart. A key of more than HOT clean records is spread over blocks of them, which each meet all its other records.
    """
    a, b = keyed(left, True), keyed(right, False)
    hot = a.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks")).filter("blocks > 1")
    a, b = (x.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) for x in (a, b))
    x = a.select("key", F.col("entity_id").alias("a_id"), F.expr("cast(pmod(xxhash64(entity_id), blocks) as int)").alias("block"))
    y = b.select("key", F.col("entity_id").alias("b_id"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    return x.join(y, ["key", "block"]).select("a_id", "b_id").distinct()


def voted(left: DataFrame, right: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate pairs with every labeler's vote. ``v_unique``: the name fits one clean record only, or several."""
    a = left.select(F.col("entity_id").alias("a_id"), pairs.side().alias("a"))
    b = right.select(F.col("entity_id").alias("b_id"), pairs.side().alias("b"))
    votes = pairs.compare(found.join(a, "a_id").join(b, "b_id"), ["a_id", "b_id"])
    fits = (F.col("v_core") == 1) & (F.col("v_words") >= 0) & (F.col("v_town") >= 0) & (F.col("v_house") >= 0) & (F.col("v_street") >= 0)
    n = F.sum(F.when(fits, 1).otherwise(0)).over(Window.partitionBy("b_id"))
    return votes.withColumn("v_unique", F.when(fits, F.when(n == 1, 1).otherwise(-1)).otherwise(0))


class LabelModel:
    """A generative model of the votes, learned without labels by expectation maximization.

    A latent class (match or not) yields the votes of each group of labelers. Labelers of one group read the same part of
    the records, so their votes are correlated: a group has a joint table of its vote patterns for each class, smoothed
    towards what its labelers' single accuracies would give. Groups are independent given the class. Works on counts of
    patterns: at most 3 to the number of labelers, whatever the data's size.
    """

    SMOOTH, ANCHOR = 5.0, 2.0

    def __init__(self, groups: list[list[str]], rounds: int = 50):
        self.groups, self.rounds = groups, rounds

    def _codes(self, votes: pd.DataFrame) -> list[np.ndarray]:
        return [(votes[g].to_numpy(int) + 1) @ (3 ** np.arange(len(g))) for g in self.groups]

    def fit(self, votes: pd.DataFrame, counts: np.ndarray) -> LabelModel:
        codes = self._codes(votes)
        sides = np.stack([np.sign(votes[g].sum(axis=1)) for g in self.groups])
        p = np.where((sides < 0).any(0), 1 - PRIOR_ACCURACY, np.where((sides > 0).all(0), PRIOR_ACCURACY, 0.5))
        # Each pattern also counts ANCHOR times as the plain majority sees it, which decides where pairs are few.
        first = p
        self.prior, self.tables = 0.5, [np.full((2, 3 ** len(g)), 3.0 ** -len(g)) for g in self.groups]
        for _ in range(self.rounds if len(votes) else 0):
            matched, other = counts * p + self.ANCHOR * first, counts * (1 - p) + self.ANCHOR * (1 - first)
            self.prior = float(np.clip(matched.sum() / (matched.sum() + other.sum()), 0.01, 0.99))
            self.tables = []
            for g, code in zip(self.groups, codes, strict=True):
                single = self._single(votes[g].to_numpy(int), other, matched)
                joint = np.stack([np.bincount(code, weight, 3 ** len(g)) for weight in (other, matched)])
                joint += self.SMOOTH * single
                self.tables.append(joint / joint.sum(1, keepdims=True))
            p = self.posterior(votes)
        return self

    @staticmethod
    def _single(votes: np.ndarray, other: np.ndarray, matched: np.ndarray) -> np.ndarray:
        """Pattern chances of both classes if each labeler voted by itself with its accuracy.

        A few prior votes of PRIOR_ACCURACY stand in where there are hardly any pairs to learn from.
        """
        out = []
        right, wrong = PRIOR_ACCURACY / 2, (1 - PRIOR_ACCURACY) / 2
        for weight, prior in ((other, [right, 0.5, wrong]), (matched, [wrong, 0.5, right])):
            cells = np.ones(1)
            for j in range(votes.shape[1]):
                one = np.bincount(votes[:, j] + 1, weight, 3) + 10 * np.array(prior)
                cells = np.outer(one / one.sum(), cells).ravel()
            out.append(cells)
        return np.stack(out)

    def posterior(self, votes: pd.DataFrame) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for table, code in zip(self.tables, self._codes(votes), strict=True):
            odds += np.log(table[1, code] / table[0, code])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracies(self, votes: pd.DataFrame, counts: np.ndarray) -> dict[str, float]:
        """Share of each labeler's votes, abstentions aside, that agree with the model's class."""
        p, out = self.posterior(votes), {}
        for v in (v for g in self.groups for v in g):
            x = votes[v].to_numpy()
            cast = counts * (x != 0)
            out[v] = float((cast * np.where(x > 0, p, 1 - p)).sum() / max(cast.sum(), 1e-9))
        return out


def confidences(votes: DataFrame) -> tuple[DataFrame, LabelModel]:
    """Every vote pattern with its posterior, and the model. Patterns are counted on the cluster; 3^9 is their bound."""
    counts = votes.groupBy(*LABELERS).agg(F.count("*").alias("n")).toPandas()
    model = LabelModel(GROUPS).fit(counts, counts["n"].to_numpy(float))
    p = model.posterior(counts)
    schema = ", ".join(f"{v} int" for v in LABELERS) + ", confidence double"
    table = [(*map(int, r), float(q)) for r, q in zip(counts[LABELERS].to_numpy(), p, strict=True)]
    return votes.sparkSession.createDataFrame(table, schema), model


def link(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """``(a_id, b_id, confidence)``: each other record with the one clean record it belongs to, if any.

    ``left`` and ``right`` are parsed records (see ``records.parse``). Confidence is the label model's posterior; pairs
    under ``least`` are left out. Of several clean records the most confident one owns the record; between equals without
    a common building nothing decides, and the record stays unlinked; in one building the smaller id owns it.
    """
    left, right = cut(left), cut(right)
    votes = cut(voted(left, right, candidates(left, right)))
    posterior, _ = confidences(votes)
    scored = votes.join(F.broadcast(posterior), LABELERS).filter(F.col("confidence") >= least)
    w = Window.partitionBy("b_id")
    best = F.row_number().over(w.orderBy(F.col("confidence").desc(), "a_id"))
    equal = F.sum(F.when(F.col("confidence") == F.col("top"), 1)).over(w)
    scored = scored.withColumn("top", F.max("confidence").over(w)).withColumn("equal", equal).withColumn("r", best)
    return scored.filter((F.col("r") == 1) & ((F.col("equal") == 1) | (F.col("v_house") == 1))).select("a_id", "b_id", "confidence")

