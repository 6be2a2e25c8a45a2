"""Exact byte-pair encoding by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: What the published split pattern comes to on ASCII text; the standard library's engine runs it faster.
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: White space (ASCII) with the characters up to the next. No piece of the split pattern reaches from a character into
#: white space after it, so chunks can be encoded one by one; not where other white space may run into the ASCII one.
_CHUNK = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
KEPT, KEPT_LENGTH = 250_000, 100


class _Memo(dict):
    """Packed ids of strings met before; forgets all when full, and never holds long ones."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        packed = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[key] = packed
        return packed


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer file; ``folder`` is a parameter, its default the installed package or /opt/tokenizers."""
    folder = folder or os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


class ByteBPE:
    """Byte-level BPE read from a ``tokenizers`` JSON file (vocabulary, merges) and its split pattern.

    A piece is encoded in one pass: an Aho-Corasick automaton over the reversed tokens names the longest token starting at
    each byte; the encoder takes the longest, checks it against its left neighbour in the pair table (would the merges
    have joined across the border?), and steps to the token's next shorter prefix, or back, where they would.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = {c: b for b, c in _byte_letters().items()}
        raw = {t: bytes(to_byte[c] for c in t) for t in model["vocab"] if all(c in to_byte for c in t)}
        self.id_of = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.token = {i: b for b, i in self.id_of.items()}
        size = max(self.token) + 1
        # joined: what a pair of ids merges to, with its rank; halves: the pair an id was merged from.
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank = [-1] * size
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b = self.id_of[raw[left]], self.id_of[raw[right]]
            whole = self.id_of[raw[left] + raw[right]]
            self.joined.setdefault((a, b), (rank, whole))
            if whole not in self.halves:
                self.halves[whole] = (a, b)
                self.rank[whole] = rank
        self.shorter = {i: self._shorter(b) for i, b in self.token.items()}
        self.reverse = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.reverse.add_word(b[::-1].decode("latin-1"), (len(b), i))
        self.reverse.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(pattern).findall
        self.pieces = _Memo(lambda piece: array("i", self.encode_piece(piece)).tobytes())
        self.chunks = _Memo(self._split_encode)
        # decoding: all tokens' bytes in one block, with the offset of each id.
        lengths = [len(self.token.get(i, b"")) for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.block = b"".join(self.token.get(i, b"") for i in range(size))

    def _shorter(self, b: bytes) -> int:
        return next((self.id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.id_of), -1)

    def compatible(self, left: int, right: int) -> bool:
        """True if the merges leave the border between two neighbouring tokens alone. Answers are kept as the pair table.

        Takes both tokens apart from the last merge back: at each step the tokens at the border are those present when
        merges up to a rank were done, so a merge across it with a lower rank than the next undone one would have come first.
        """
        if (known := self.pairs.get((left, right))) is not None:
            return known
        a, b, bound, free = left, right, len(self.joined) + 1, True
        while True:
            across = self.joined.get((a, b))
            if across is not None and across[0] < bound:
                free = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            # The later merge is undone; of equal ones the right. A merge across the border lies left of the right token's
            # merge, so it also comes first when the ranks are equal.
            if ra > rb:
                bound, a = ra, self.halves[a][1]
            else:
                bound, b = rb + 1, self.halves[b][0]
        if len(self.pairs) < 2_000_000:
            self.pairs[left, right] = free
        return free

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        if (whole := self.id_of.get(data)) is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        size = [0] * n
        for end, (length, i) in self.reverse.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end
            if length > size[at]:
                size[at], longest[at] = length, i
        out: list[int] = []
        at, token = 0, longest[0]
        dead = bytearray(n + 1)  # positions from which no valid ending was found
        while True:
            length = len(self.token[token])
            if not dead[at + length] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at += length
                if at == n:
                    return out
                token = longest[at]
            elif (less := self.shorter[token]) >= 0:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(self.token[token])

    def _split_encode(self, text: str) -> bytes:
        pieces = _ASCII.findall(text) if text.isascii() else self.split(text)
        return b"".join(map(self.pieces.__getitem__, pieces))

    def packed(self, text: str | None) -> bytes:
        """The ids of ``text`` as 32-bit integers; null and empty texts have none."""
        if not text:
            return b""
        if _WIDE_SPACE.search(text):
            return self._split_encode(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        o, block = self.offsets, self.block
        return b"".join(block[o[i] : o[i + 1]] for i in ids)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    return letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}


@cache
def load(name: str = "byte_bpe_50k", folder: str | None = None) -> ByteBPE:
    """One encoder a Python worker; the split pattern is the one published with the vocabulary files."""
    return ByteBPE(tokenizer_path(f"{name}.json", folder), _pattern())


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """Texts of the second column, a few at a time, so that long ones are not all Python strings at once."""
    col = batch.column(1)
    for i in range(0, len(col), 256):
        yield from col.slice(i, 256).to_pylist()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(id, ids)`` of every row, without special tokens; null, empty: an empty list. Repeated rows stay repeated.

    Reads two columns, keeps partitioning, shuffles nothing. Text is encoded whole at any length; strings that look like
    special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, folder)
        for batch in batches:
            packed = [bpe.packed(text) for text in _texts(batch)]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(id, tokens)``: the number of ids of every row, 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, folder)
        for batch in batches:
            sizes = [len(bpe.packed(text)) // 4 for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[id_col, "tokens"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, tokens int")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(id, text)`` of lists of ids; an empty list gives an empty text, null gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, folder)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = df.select(id_col, ids_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")
