"""Filling containers of fixed capacity by bin completion (branch and bound)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.sources.tables import cut

#: Items packed together; containers with more unused space than OPEN are emptied and packed again across blocks.
BLOCK, OPEN = 2048, 0.01
#: Blocks that a partition of the second round holds.
BLOCKS = 4
NODES, VISITS, BRANCHES = 4000, 400, 4


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of positions in ``sizes``, which must be in descending order."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i, s in enumerate(sizes):
        at = bisect_left(room, (s, -1))
        if at < len(room):
            r, b = room.pop(at)
            bins[b].append(i)
            insort(room, (r - s, b))
        else:
            bins.append([i])
            insort(room, (capacity - s, len(bins) - 1))
    return bins


def dominated(chosen: list[int], left: int, spare: list[int]) -> bool:
    """True if some of the ``chosen`` sizes could give way to one larger item of ``spare`` (ascending sizes) that still fits.

    The items given up fit wherever that item would have gone, so the filling with it is at least as good. Giving up
    nothing is the case that an item still fits in what is ``left``.
    """
    sums = {0}
    for size in chosen:
        sums |= {s + size for s in sums}
    return any((at := bisect_right(spare, s)) < len(spare) and spare[at] <= s + left for s in sums)


def completions(sizes: list[int], counts: list[int], start: int, room: int, allowed: int, visits: int | None = VISITS, branches: int | None = BRANCHES) -> list[tuple[int, list[tuple[int, int]]]]:
    """Undominated fillings of ``room`` from distinct descending ``sizes``: ``(waste, [(index, count)])``, least waste first.

    Larger sizes are tried first, a branch whose whole remainder cannot bring the waste under ``allowed`` is cut, and a
    filling without waste ends the search. ``visits`` and ``branches`` bound the search; None: all fillings.
    """
    n = len(sizes)
    rest = [0] * (n + 1)
    for i in range(n - 1, start - 1, -1):
        rest[i] = rest[i + 1] + sizes[i] * counts[i]
    smallest = next((sizes[i] for i in range(n - 1, start - 1, -1) if counts[i]), 0)
    found: list[tuple[int, list[tuple[int, int]]]] = []
    stack: list[tuple[int, int, list[tuple[int, int]]]] = [(start, room, [])]
    seen = 0
    while stack and (visits is None or seen < visits):
        seen += 1
        i, left, chosen = stack.pop()
        while i < n and (sizes[i] > left or not counts[i]):
            i += 1
        if i == n or left < smallest:
            if left == 0:
                found.append((0, chosen))
                break
            if left <= allowed:
                taken = dict(chosen)
                spare = [sizes[j] for j in range(n - 1, start - 1, -1) if counts[j] > taken.get(j, 0)]
                if not dominated([sizes[j] for j, c in chosen for _ in range(c)], left, spare):
                    found.append((left, chosen))
            continue
        if left - rest[i] > allowed:
            continue
        most = min(counts[i], left // sizes[i])
        stack.append((i + 1, left, chosen))
        for c in range(1, most + 1):
            stack.append((i + 1, left - c * sizes[i], [*chosen, (i, c)]))
    found.sort(key=lambda f: (f[0], len(f[1])))
    return found[:branches]


def pack_block(items: list[int], capacity: int, exact: bool = False) -> list[list[int]]:
    """Bins of positions in ``items`` (sizes from 1 to ``capacity``), as few as the search finds; best fit is the incumbent.

    Around the largest item left, the undominated fillings are tried in order of waste. The search goes back when the
    waste so far rules out fewer bins than the incumbent has, and ends at the lower bound or, as packing is NP-hard, after
    NODES nodes. ``exact``: it ends only when nothing is left to try, so the bins are the fewest there are (small blocks).
    """
    nodes_most, visits, branches = (None, None, None) if exact else (NODES, VISITS, BRANCHES)
    order = sorted(range(len(items)), key=lambda i: (-items[i], i))
    desc = [items[i] for i in order]
    total = sum(desc)
    best = best_fit(desc, capacity)
    bound = -(-total // capacity)
    if len(best) > bound:
        sizes = sorted(set(desc), reverse=True)
        index = {s: k for k, s in enumerate(sizes)}
        stacks: list[list[int]] = [[] for _ in sizes]
        for i in range(len(desc) - 1, -1, -1):
            stacks[index[desc[i]]].append(i)
        counts = [len(s) for s in stacks]
        path: list[tuple[int, list[tuple[int, int]]]] = []
        waste, nodes, left = 0, 0, len(desc)
        frames: list[list] = []
        allowed = (len(best) - 1) * capacity - total

        def options() -> list:
            first = next(k for k, c in enumerate(counts) if c)
            counts[first] -= 1
            got = completions(sizes, counts, first, capacity - sizes[first], allowed - waste, visits, branches)
            counts[first] += 1
            return [(w, [(first, 1), *c]) for w, c in reversed(got)]

        frames.append(options())
        while frames and (nodes_most is None or nodes < nodes_most):
            nodes += 1
            if not frames[-1]:
                frames.pop()
                if path:
                    w, chosen = path.pop()
                    waste -= w
                    for k, c in chosen:
                        counts[k] += c
                        left += c
                continue
            w, chosen = frames[-1].pop()
            if waste + w > allowed:
                continue
            for k, c in chosen:
                counts[k] -= c
                left -= c
            path.append((w, chosen))
            waste += w
            if left:
                frames.append(options())
                continue
            at = [list(s) for s in stacks]
            best = [[at[k].pop() for k, c in chosen for _ in range(c)] for _, chosen in path]
            if len(best) <= bound:
                break
            allowed = (len(best) - 1) * capacity - total
            frames.append([])
    return [[order[i] for i in b] for b in best]


def _pack(limits: list[tuple[int, int]], round_no: int):
    columns = ["limit_id", "capacity", "container_id", "doc_id", "piece", "tokens", "open"]
    of = dict(limits)

    def block(limit: int, docs: list, pieces: list[int], sizes: list[int], last: list[int]) -> pd.DataFrame:
        capacity = of[limit]
        bins = pack_block([s for s in sizes if s], capacity)
        at = [i for i, s in enumerate(sizes) if s]
        bins = [[at[i] for i in b] for b in bins]
        if len(at) < len(sizes):
            empty = [i for i, s in enumerate(sizes) if not s]
            bins = [bins[0] + empty, *bins[1:]] if bins else [empty]
        rows = []
        for b in bins:
            fill = sum(sizes[i] for i in b)
            is_open = fill < (1 - OPEN) * capacity
            rows += [(limit, capacity, last[0], docs[i], pieces[i], sizes[i], is_open) for i in b]
            last[0] += 1
        return pd.DataFrame(rows, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = [(round_no << 60) + (TaskContext.get().partitionId() << 36)]
        held: dict[int, tuple[list, list, list]] = {k: ([], [], []) for k in of}
        for df in batches:
            whole = []
            for limit, doc, piece, tokens in zip(df.limit_id, df.doc_id, df.piece, df.tokens, strict=True):
                capacity, (docs, pieces, sizes) = of[limit], held[limit]
                while tokens > capacity:
                    whole.append((limit, capacity, last[0], doc, piece, capacity, False))
                    last[0] += 1
                    piece, tokens = piece + 1, tokens - capacity
                docs.append(doc)
                pieces.append(piece)
                sizes.append(tokens)
                if len(sizes) >= BLOCK:
                    yield block(limit, docs, pieces, sizes, last)
                    held[limit] = ([], [], [])
            if whole:
                yield pd.DataFrame(whole, columns=columns)
        for limit, (docs, pieces, sizes) in held.items():
            if sizes:
                yield block(limit, docs, pieces, sizes, last)

    return run


def fill(sizes: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """``(limit_id, capacity, container_id, doc_id, piece, tokens)``: every document of ``(doc_id, tokens)`` in a container of each limit.

    ``limits`` are (limit_id, capacity) pairs, few by nature. A document larger than the capacity is cut into full
    containers and a remainder (pieces 0, 1, ...); no other is split. Null and empty texts (0 tokens) go in an existing
    container. First round: blocks of BLOCK documents as the partitions hold them, without a shuffle; second round: what
    lies in containers with over OPEN unused space is packed again across partitions, in the order of a hash, so that
    every block has items of all sizes, and in as many partitions as its rows need. Empty input: no rows.
    """
    schema = "limit_id int, capacity int, container_id bigint, doc_id bigint, piece int, tokens int, open boolean"
    of_limit = F.explode(F.array(*[F.lit(k) for k, _ in limits]).cast("array<int>"))
    items = sizes.select(of_limit.alias("limit_id"), "doc_id", F.lit(0).alias("piece"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    first = cut(items.mapInPandas(_pack(limits, 0), schema))
    again = first.filter("open").select("limit_id", "doc_id", "piece", "tokens")
    order = F.xxhash64("doc_id", "piece")
    parts = max(1, again.count() // (BLOCKS * BLOCK))
    again = again.repartition(parts, order).sortWithinPartitions(order, "doc_id", "piece")
    second = again.mapInPandas(_pack(limits, 1), schema)
    return first.filter("not open").unionByName(second).drop("open")
