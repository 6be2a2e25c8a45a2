"""Edit-based ratios of many text pairs at once: bit-parallel subsequence lengths over numpy words, a column of pairs a step."""

from __future__ import annotations

import numpy as np

#: Cells (pairs x letters x letters) that one block of pairs may take, and the length from which on a pair is taken by itself.
CELLS, LONG = 4_000_000, 1024
_OUTSIDE = np.uint32(0xFFFFFFFF)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts, one row each, padded by a code that no letter has."""
    n = max(map(len, texts), default=0)
    if not n:
        return np.zeros((len(texts), 0), np.uint32)
    out = np.array([t.replace("\0", "�") for t in texts], dtype=f"U{n}").view(np.uint32).reshape(len(texts), n)
    return np.where(out == 0, _OUTSIDE, out)


def _masks(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair and place in ``b`` the bits of the places in ``a`` with that letter: (pairs, places, words)."""
    x, y = _codes(a), _codes(b)
    y = np.where(y == _OUTSIDE, _OUTSIDE - 1, y)
    bits = np.packbits(x[:, None, :] == y[:, :, None], axis=-1, bitorder="little")
    words = -(-x.shape[1] // 64)
    out = np.zeros((len(a), y.shape[1], words * 8), np.uint8)
    out[:, :, : bits.shape[2]] = bits
    return out.view(np.uint64)


def _step(rows: list[np.ndarray], hits: list[np.ndarray]) -> None:
    """One letter of the second text: the row of each pair, kept in words, takes part in one addition with carry."""
    carry = None
    for k, (row, mask) in enumerate(zip(rows, hits, strict=True)):
        hit = row & mask
        total = row + hit
        over = total < row
        if carry is not None:
            total = total + carry
            over |= (total == 0) & (carry == 1)
        rows[k] = total | (row - hit)
        carry = over.astype(np.uint64) if k + 1 < len(rows) else None


def _full(lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """All bits below each length, by words."""
    out = []
    for k in range(words):
        left = np.clip(lengths - 64 * k, 0, 64)
        out.append(np.where(left == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1)))
    return out


def _blocks(order: np.ndarray, cost) -> list[np.ndarray]:
    """``order`` in runs whose cells stay within CELLS; ``cost`` of a pair never falls along it."""
    out, start = [], 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - start) * cost(order[end]) > CELLS:
            out.append(order[start:end])
            start = end
    return out


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    la, lb = np.array([len(x) for x, _ in pairs], np.int64), np.array([len(y) for _, y in pairs], np.int64)
    for i in np.flatnonzero(lb > LONG):
        out[i] = _lcs_one(*pairs[i])
    some = np.flatnonzero((la > 0) & (lb <= LONG))
    order = some[np.lexsort((lb[some], -(-la[some] // 64)))]
    words = -(-la[order] // 64)
    for k in np.unique(words):
        for block in _blocks(order[words == k], lambda i, k=k: 64 * k * lb[i]):
            masks = _masks([pairs[i][0] for i in block], [pairs[i][1] for i in block])
            full = _full(la[block], masks.shape[2])
            rows = [f.copy() for f in full]
            for j in range(masks.shape[1]):
                _step(rows, [masks[:, j, w] for w in range(masks.shape[2])])
            out[block] = la[block] - sum(np.bitwise_count(r & f).astype(np.int64) for r, f in zip(rows, full, strict=True))
    return out


def _lcs_one(a: str, b: str) -> int:
    """The same for one pair of any length, with one integer as the row."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for ch in b:
        if mask := masks.get(ch):
            hit = row & mask
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    """200 times the common subsequence over both lengths; 100 for two empty texts."""
    n = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], float)
    return np.where(n > 0, 200.0 * lcs_many(a, b) / np.maximum(n, 1), 100.0)


def token_sort_many(a: list[str], b: list[str]) -> np.ndarray:
    tidy = lambda texts: [" ".join(sorted(t.split())) for t in texts]
    return ratio_many(tidy(a), tidy(b))


def token_set_many(a: list[str], b: list[str]) -> np.ndarray:
    """100 where words are shared and one side adds none, else the best of the shared words with either side and both sides."""
    out = np.zeros(len(a))
    left: list[str] = []
    right: list[str] = []
    of: list[int] = []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = set(s.split()), set(t.split())
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 100.0
            continue
        shared = " ".join(sorted(both))
        with_x, with_y = (f"{shared} {' '.join(sorted(z - both))}".strip() for z in (x, y))
        rows = [(with_x, with_y), (shared, with_x), (shared, with_y)] if both else [(with_x, with_y)]
        for u, v in rows:
            left.append(u)
            right.append(v)
            of.append(i)
    np.maximum.at(out, of, ratio_many(left, right))
    return out


def partial_many(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter text of each pair with a window of the longer, windows at the ends included."""
    out = np.zeros(len(a))
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    la, lb = np.array([len(x) for x, _ in pairs], np.int64), np.array([len(y) for _, y in pairs], np.int64)
    inside = np.array([bool(x) and x in y for x, y in pairs], bool)
    out[inside] = 100.0
    open_pairs = np.flatnonzero((la > 0) & ~inside)
    for i in open_pairs[lb[open_pairs] > LONG]:
        x, y = pairs[i]
        out[i] = max(200.0 * _lcs_one(x, w) / (len(x) + len(w)) for w in (y[max(0, s) : s + len(x)] for s in range(1 - len(x), len(y))))
    open_pairs = open_pairs[lb[open_pairs] <= LONG]
    order = open_pairs[np.lexsort((lb[open_pairs], la[open_pairs]))]
    for n in np.unique(la[order]):
        for block in _blocks(order[la[order] == n], lambda i, n=n: 8 * (-(-n // 64)) * max(n * lb[i] // 8, n + lb[i])):
            masks = _masks([pairs[i][0] for i in block], [pairs[i][1] for i in block])
            count, places, words = masks.shape
            padded = np.zeros((words, count, places + 2 * (n - 1)), np.uint64)
            padded[:, :, n - 1 : n - 1 + places] = masks.transpose(2, 0, 1)
            windows = n + places - 1
            full = _full(np.full(1, n), words)
            rows = [np.broadcast_to(f, (count, windows)).copy() for f in full]
            for t in range(n):
                _step(rows, [padded[w, :, t : t + windows] for w in range(words)])
            common = n - sum(np.bitwise_count(r & f).astype(np.int64) for r, f in zip(rows, full, strict=True))
            start = np.arange(1 - n, places)[None, :]
            length = np.minimum(start + n, lb[block][:, None]) - np.maximum(start, 0)
            out[block] = np.where(length > 0, 200.0 * common / (n + np.maximum(length, 0)), 0.0).max(axis=1)
    return out
