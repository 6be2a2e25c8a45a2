"""Most similar vectors for every vector, by shifted Hilbert curves through projected vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.sources.tables import cut

#: Curves, dimensions of each projection, bits of each coordinate, neighbours looked at on either side along a curve.
CURVES, DIMS, BITS, REACH = 8, 10, 6, 192
#: Points up to which CURVES do; each doubling takes two more, as along one curve more strangers come between neighbours.
POINTS = 65_536
#: Rows of a curve that a partition holds, and copies of one vector that one key of the last join has, at most about.
ROWS, COPIES = 100_000, 10_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows of ``cells``, ``bits`` bits a coordinate).

    The axes are turned into the transposed curve index by undoing excess rotations from the top bit down, Gray-decoded,
    and the bits interleaved; all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curves(width: int, count: int, dims: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal projections (count, width, dims) and shifts (count, dims) in cell widths."""
    rng = np.random.default_rng(seed)
    dims = min(dims, width)
    projections = [np.linalg.qr(rng.standard_normal((width, width)))[0][:, :dims] for _ in range(count)]
    return np.stack(projections).astype(np.float32), rng.random((count, dims)).astype(np.float32)


def _unit(raw: list[bytes] | pd.Series, width: int) -> np.ndarray:
    """Unit rows of packed vectors, kept as half precision (two bytes a number) or single."""
    raw = list(raw)
    short = np.array([len(v) == 2 * width for v in raw], bool)
    x = np.empty((len(raw), width))
    for half, kind in ((True, np.float16), (False, np.float32)):
        at = np.flatnonzero(short == half)
        if len(at):
            x[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(width: int, mean: np.ndarray, scale: float, count: int, dims: int, bits: int):
    projections, shifts = curves(width, count, dims)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if df.empty:
                continue
            x = (_unit(df.vec, width) - mean).astype(np.float32)
            for c in range(count):
                # Four standard deviations to either side over the range of cells, moved by the curve's shift.
                cell = ((x @ projections[c]) / (8 * scale) + 0.5 + (shifts[c] - 0.5) / 8) * (1 << bits)
                key = hilbert_keys(np.clip(cell, 0, (1 << bits) - 1).astype(np.int64), bits)
                yield pd.DataFrame({"curve": c, "key": key, "rep": df.rep, "vec": df.vec})

    return run


def _nearest(width: int, k: int, reach: int):
    block = max(64, reach)

    def top(rows: np.ndarray, ids: np.ndarray, lo: int, hi: int) -> Iterator[pd.DataFrame]:
        """The k best of rows[lo:hi] among the rows within ``reach`` on either side."""
        for a in range(lo, hi, block):
            b = min(hi, a + block)
            left, right = max(0, a - reach), min(len(rows), b + reach)
            cos = rows[a:b] @ rows[left:right].T
            cos[np.arange(b - a), np.arange(a - left, b - left)] = -2.0
            m = min(k, cos.shape[1] - 1)
            if m < 1:
                continue
            best = np.argpartition(-cos, m - 1, axis=1)[:, :m] if m < cos.shape[1] else np.tile(np.arange(m), (b - a, 1))
            yield pd.DataFrame({"a": np.repeat(ids[a:b], m), "b": ids[left:right][best.ravel()], "cos": np.take_along_axis(cos, best, 1).ravel().astype(np.float64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come in curve order. Held: the rows not yet answered, with those within reach before them.
        rows, ids, curve, done = np.zeros((0, width)), np.zeros(0, np.int64), -1, 0
        for df in batches:
            x, of, n = _unit(df.vec, width), df.curve.to_numpy(), df.rep.to_numpy()
            for c in np.unique(of):
                if c != curve:
                    yield from top(rows, ids, done, len(rows))
                    rows, ids, curve, done = np.zeros((0, width)), np.zeros(0, np.int64), c, 0
                rows, ids = np.vstack([rows, x[of == c]]), np.concatenate([ids, n[of == c]])
                ready = max(done, len(rows) - reach)
                yield from top(rows, ids, done, ready)
                keep = max(0, ready - reach)
                rows, ids, done = rows[keep:], ids[keep:], ready - keep
        yield from top(rows, ids, done, len(rows))

    return run


def _edges(reach: int):
    """The first and the last ``reach`` rows of a partition, for the borders with the partitions before and behind it.

    ``run`` tells a border and a curve apart: rows of two partitions meet only on one curve.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count = TaskContext.get().partitionId(), 0
        last = None
        for df in batches:
            if count < reach:
                head = df.iloc[: reach - count]
                yield head.assign(run=part * 1000 + head.curve, side=1, at=range(count, count + len(head))).drop(columns=["curve", "key"])
            count += len(df)
            last = df.iloc[-reach:] if last is None else pd.concat([last, df]).iloc[-reach:]
        if last is not None:
            yield last.assign(run=(part + 1) * 1000 + last.curve, side=0, at=range(len(last))).drop(columns=["curve", "key"])

    return run


def _sums(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(width), 0.0
        for df in batches:
            if len(df):
                x = _unit(df.vec, width)
                n, s, q = n + len(x), s + x.sum(0), q + float((x * x).sum())
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q]})

    return run


def _pack(width: int):
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        def one(a):
            x = np.asarray(a, np.float32)
            if len(x) != width or not np.isfinite(x).all() or not x.any():
                return None
            with np.errstate(over="ignore"):
                half = x.astype(np.float16)
            return half.tobytes() if np.array_equal(half.astype(np.float32), x) else x.tobytes()

        return v.map(one, na_action="ignore")

    return pack


def most_similar(df: DataFrame, id_col: str, vec_col: str, k: int = 10, width: int = 64, count: int | None = None, dims: int = DIMS, bits: int = BITS, reach: int = REACH) -> DataFrame:
    """``(vec_id, neighbour_id, cosine)``: for every vector the k others of highest cosine, ties by smaller id.

    Every vector is indexed and asked for. Equal vectors are one point on the curves, so a group of copies of any size
    costs one row a curve; each copy then gets its own list: its copies (smallest ids first) and the members of the
    nearest other points. Null vectors, vectors of another width, with NaN or infinity, or of length zero take no part.
    Approximate: a neighbour is missed where it lies within reach on none of the curves; see the README for the recall
    measured against brute force. ``count``: curves, by default as many as the number of points takes. Mean and spread come from all points. Empty input: no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), _pack(width)(F.col(vec_col)).alias("vec")).filter("vec is not null")
    points = cut(rows.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n")))
    sums = points.select("vec").mapInPandas(_sums(width), "n bigint, s array<double>, q double")
    total = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"), F.sum("q").alias("q")).first()
    n = total["n"] or 0
    mean = np.array(total["s"], float) / n if n else np.zeros(width)
    count = count or CURVES + 2 * max(0, math.ceil(math.log2(max(n, 1) / POINTS)))
    scale = float(np.sqrt(max((total["q"] / n if n else 1.0) - mean @ mean, 1e-12) / width))
    keyed = points.select("rep", "vec").mapInPandas(_keys(width, mean, scale, count, dims, bits), "curve int, key bigint, rep bigint, vec binary")
    # Partitions of many times the reach, so that a window meets one border at most.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n * count // (8 * reach), max(tasks, n * count // ROWS)))
    ordered = cut(keyed.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key", "rep"))
    inside = ordered.mapInPandas(_nearest(width, k, reach), "a bigint, b bigint, cos double")
    # Windows that reach over a border of partitions: the last rows of one meet the first of the next.
    edges = ordered.mapInPandas(_edges(reach), "rep bigint, vec binary, run bigint, side int, at int")
    seams = edges.repartition("run").sortWithinPartitions("run", "side", "at").select(F.col("run").alias("curve"), "rep", "vec")
    near = inside.unionByName(seams.mapInPandas(_nearest(width, k, reach), "a bigint, b bigint, cos double"))
    merged = near.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cos").desc(), "b"))).filter(F.col("r") <= k).drop("r")

    # Copies: the first k + 1 ids of each point are all that any list can need.
    multi = points.filter("n > 1").select("vec", "rep", "n")
    members = rows.select("vec_id", "vec").distinct().join(multi, "vec").select("rep", "vec_id", F.ceil(F.col("n") / COPIES).cast("int").alias("salts"))
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    single = points.filter("n = 1").select("rep", F.col("rep").alias("vec_id"))
    first_ids = few.select("rep", "vec_id").unionByName(single)
    others = best.join(first_ids.withColumnRenamed("rep", "b"), "b").select("a", F.col("vec_id").alias("neighbour_id"), "cos")
    own = few.select(F.col("rep").alias("a"), F.col("vec_id").alias("neighbour_id"), F.lit(1.0).alias("cos"))
    lists = others.unionByName(own)
    lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cos").desc(), "neighbour_id"))).filter(F.col("r") <= k + 1)
    lists = lists.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour_id", "cos"))).alias("list"))
    # A point with many copies is spread over as many salted keys as its copies need.
    salts = multi.select(F.col("rep").alias("a"), F.ceil(F.col("n") / COPIES).cast("int").alias("salts"))
    salted = lists.join(salts, "a", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")))
    every = members.unionByName(single.withColumn("salts", F.lit(1))).withColumnRenamed("rep", "a").withColumn("salt", F.expr("cast(pmod(xxhash64(vec_id), salts) as int)"))
    # At most k + 1 entries a list: without the vector itself, k are left.
    own_list = F.slice(F.filter("list", lambda x: x["neighbour_id"] != F.col("vec_id")), 1, k)
    out = every.join(salted, ["a", "salt"]).select("vec_id", F.explode(own_list).alias("x"))
    return out.select("vec_id", F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.cos").alias("cosine"))


def pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct pairs, smaller id first, in which at least one vector is among the other's most similar."""
    a, b = F.col("vec_id"), F.col("neighbour_id")
    return neighbours.select(F.least(a, b).alias("a_vec_id"), F.greatest(a, b).alias("b_vec_id")).distinct()
