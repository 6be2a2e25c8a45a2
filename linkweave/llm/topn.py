"""Top N of every group by merging sorted runs with a loser tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = (float("inf"), "\U0010ffff")


class LoserTree:
    """Merges sorted runs of ``(-score, item)``: each step costs one path of comparisons from a leaf to the root."""

    def __init__(self, runs: list[list[tuple[float, str]]]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.k = k
        self.tree = [-1] * k
        for leaf in range(k):
            self._play(leaf, building=True)

    def _head(self, leaf: int) -> tuple[float, str]:
        i = self.at[leaf]
        return self.runs[leaf][i] if i < len(self.runs[leaf]) else END

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            rival = self.tree[node]
            if rival < 0:
                if building:
                    self.tree[node] = winner
                    return
            elif self._head(rival) < self._head(winner):
                self.tree[node], winner = winner, rival
            node //= 2
        self.tree[0] = winner

    def pop(self) -> tuple[float, str] | None:
        leaf = self.tree[0]
        if (head := self._head(leaf)) is END:
            return None
        self.at[leaf] += 1
        self._play(leaf)
        return head


def merge(runs: list[list[tuple[float, str]]], n: int) -> list[tuple[float, str]]:
    """The first ``n`` distinct items of the merged runs; the rest of the runs is never looked at."""
    if len(runs) == 1:
        pop = iter(runs[0]).__next__
    else:
        tree = LoserTree(runs)
        pop = tree.pop
    out: list[tuple[float, str]] = []
    seen: set[str] = set()
    while len(out) < n:
        try:
            head = pop()
        except StopIteration:
            break
        if head is None:
            break
        if head[1] not in seen:
            seen.add(head[1])
            out.append(head)
    return out


def _cut_runs(n: int):
    """Of a partition sorted by group, score and item: the first n distinct items of each group, then on to the next group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, taken = None, set()
        for df in batches:
            df = df[~df.duplicated(["g", "item"])]
            if df.empty:
                continue
            if df.g.iloc[0] == group:
                df = df[~((df.g == group) & df["item"].isin(taken))]
            else:
                taken = set()
            if df.empty:
                continue
            rank = df.groupby("g", sort=False).cumcount().to_numpy()
            rank = rank + np.where(df.g.to_numpy() == group, len(taken), 0)
            kept = df[rank < n]
            last = df.g.iloc[-1]
            taken = (taken if last == group else set()) | set(kept["item"][kept.g == last])
            group = last
            yield kept

    return run


def _merge_runs(n: int):
    columns = ["g", "item", "score", "part", "rank"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, runs = None, {}

        def done() -> list[tuple]:
            return [(key[0], i, -s, key[1], k) for k, (s, i) in enumerate(merge(list(runs.values()), n))]

        for df in batches:
            rows = []
            for g, item, score, part, r in zip(df.g, df["item"], df.score, df.part, df.run, strict=True):
                if (g, part) != key:
                    if key is not None:
                        rows += done()
                    key, runs = (g, part), {}
                runs.setdefault(r, []).append((-score, item))
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if key is not None:
            yield pd.DataFrame(done(), columns=columns)

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, fan_in: int = 512) -> DataFrame:
    """``(group, item, score, rank)``: the n distinct items of highest score of each group, ties by item ascending.

    Rows with null group, item or score, or NaN score, are left out; an item delivered twice counts once, at its best
    score; a group with fewer items gives all; an empty table gives none. No other column is read. Every input partition
    is sorted in place and cut to n rows a group before anything is shuffled, so a group of any size sends n rows per
    run; runs are merged ``fan_in`` at a time, in more rounds where there are more runs.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    rows = rows.filter(F.col("g").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    n_runs = rows.rdd.getNumPartitions()
    order = [F.col("g"), F.col("score").desc(), F.col("item")]
    runs = rows.sortWithinPartitions(*order).mapInPandas(_cut_runs(n), "g string, item string, score double").withColumn("run", F.spark_partition_id())
    schema = "g string, item string, score double, part int, rank int"
    while True:
        parts = max(1, -(-n_runs // fan_in))
        runs = runs.withColumn("part", (F.col("run") % parts).cast("int")).select("g", "item", "score", "part", "run")
        runs = runs.repartition("g", "part").sortWithinPartitions("g", "part", "run", F.col("score").desc(), "item").mapInPandas(_merge_runs(n), schema)
        if parts == 1:
            break
        runs, n_runs = runs.withColumn("run", F.col("part")), parts
    return runs.select(F.col("g").alias(group), F.col("item").alias(item), F.col("score").alias(score), F.col("rank"))
