"""How two business records that were taken apart compare: the votes that linkage operators weigh or check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.records import similarity

VOTES = ["v_house", "v_street", "v_town", "v_pin", "v_core", "v_words", "v_extra", "v_initials"]


def once(f: Callable) -> Callable:
    """``f`` of two records, kept for the pair asked for last, which several votes and measures ask for in turn."""
    kept: list = [None, None, None]

    @wraps(f)
    def ask(a, b):
        if kept[0] is not a or kept[1] is not b:
            kept[:] = a, b, f(a, b)
        return kept[2]

    return ask


@once
def reading(a, b) -> tuple[str, float]:
    """How two names read as one, and their likeness so read: ``initials`` (1 or 0), ``unsure`` initials of a web name, ``web``, ``core`` or ``whole``.

    Initials are held against first letters, a web name against the beginning of the other run together or its own word,
    own words against each other, also cut off, run together or spread over other words; names without own words as wholes.
    """
    for x, y in ((a, b), (b, a)):
        if x.initials:
            if y.initials:
                return "initials", float(x.letters == y.letters)
            if y.site:
                return "unsure", 0.0
            full, got = y.letters, x.letters
            hit = got == full or len(got) > 1 and (full.startswith(got) or sorted(got) == sorted(full))
            return "initials", float(hit)
    for x, y in ((a, b), (b, a)):
        if x.site:
            if y.site:
                n = min(len(x.site), len(y.site))
                return "web", similarity(x.site[:n], y.site[:n])
            return "web", max(similarity(x.site, y.whole[: len(x.site)]), similarity(x.site, y.core) if y.core else 0.0)
    if a.core and b.core:
        s = similarity(a.core, b.core)
        if s < SAME:
            short, long = sorted((a.core, b.core), key=len)
            if len(short) >= 5 and (short in long or similarity(short, long[: len(short)]) >= 0.85 or similarity(short, long[-len(short) :]) >= 0.85):
                s = 0.8
            else:
                s = max(s, similarity(a.whole, b.whole))
        return "core", s
    return "whole", similarity(a.whole, b.whole) if a.whole and b.whole else 0.0


#: Likeness from which on own words are the same, and under which they differ.
SAME, OTHER = 0.72, 0.6


def name_votes(a, b) -> tuple[int, int, int, int]:
    """Votes 1 (same), -1 (different), 0 (can't tell) of: own words, common words, words of one side only, initials."""
    kind, s = reading(a, b)
    if kind in ("initials", "unsure"):
        return (0, 0, 0, 0 if kind == "unsure" else 1 if s else -1)
    if kind == "web":
        return (1 if s >= 0.75 else -1 if s < OTHER else 0, 0, 0, 0)
    core = (1 if s >= SAME else -1 if s < OTHER else 0) if kind == "core" else int(s >= 0.85)
    ca, cb = {w[:4] for w in a.common}, {w[:4] for w in b.common}
    both = len(ca & cb)
    few = min(len(ca), len(cb))
    words = 0 if not few else 1 if both >= 0.75 * few else -1 if both < 0.5 * few else 0
    extra = 0 if not few else -1 if ca - cb and cb - ca else 1
    return (core, words, extra, 0)


def place_votes(a, b) -> tuple[int, int, int, int]:
    """Votes of house number (with its letter), street, town and postcode."""
    house = 0 if not a.house or not b.house else 1 if a.house == b.house and a.suffix == b.suffix else -1
    if not a.street or not b.street:
        street = 0
    else:
        s = similarity(a.street, b.street)
        short, long = sorted((a.street, b.street), key=len)
        if s < 0.7 and len(short) > 3 and (long.startswith(short) or long.endswith(short)):
            s = 0.7
        street = 1 if s >= 0.7 or s >= 0.6 and house == 1 and a.kind and a.kind == b.kind else -1
        if street == 1 and (a.kind and b.kind and a.kind != b.kind or a.way and b.way and a.way != b.way):
            street = -1
    known = lambda t: t is not None and t == t
    town = 0 if not known(a.town) or not known(b.town) else 1 if a.town == b.town else -1
    pin = 0 if not a.pin or not b.pin else 1 if a.pin == b.pin else -1
    return (house, street, town, pin)


def may_be_one_place() -> Column:
    """Whether number, town and postcode of the structs a and b leave open that they are one place, as ``place_votes`` says of them."""
    a, b = (lambda c, s=s: F.col(f"{s}.{c}") for s in "ab")
    blank = lambda c: F.coalesce(a(c), F.lit("")).eqNullSafe("") | F.coalesce(b(c), F.lit("")).eqNullSafe("")
    nowhere = a("town").isNull() | b("town").isNull()
    house = blank("house") | (a("house") == b("house")) & a("suffix").eqNullSafe(b("suffix"))
    return house & F.when(nowhere, blank("pin") | (a("pin") == b("pin"))).otherwise(a("town") == b("town"))


class Side(NamedTuple):
    """What a comparison reads of one parsed record."""

    core: str
    common: list[str]
    letters: str
    whole: str
    site: str
    initials: bool
    house: str
    suffix: str
    street: str
    kind: str
    way: str
    town: float | None
    pin: str


SIDE = list(Side._fields)


#: Fields and votes of the two parts of a comparison.
NAME, PLACE = SIDE[:6], SIDE[6:]
NAME_VOTES, PLACE_VOTES = VOTES[4:], VOTES[:4]


def compare(rows: DataFrame, keep: list[str], measures: dict[str, Callable] | None = None, parts: tuple[str, ...] = ("place", "name")) -> DataFrame:
    """The ``keep`` columns of candidate pairs (``a`` and ``b`` are structs of SIDE) with their VOTES and other measures of a and b.

    ``parts``: only the votes of places or of names; fields of the other part don't reach the workers and are empty there.
    """
    measures = measures or {}
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    of = {"place": (place_votes, PLACE, PLACE_VOTES), "name": (name_votes, NAME, NAME_VOTES)}
    fields = [c for c in SIDE if any(c in of[p][1] for p in parts)]
    names = [v for p in parts for v in of[p][2]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = df[keep].copy()
            left, right = (_sides(df, s, fields) for s in "ab")
            said = [(*(v for p in parts for v in of[p][0](a, b)), *(f(a, b) for f in measures.values())) for a, b in zip(left, right, strict=True)]
            for k, name in enumerate([*names, *measures]):
                out[name] = pd.Series([v[k] for v in said], index=out.index, dtype="int32" if k < len(names) else "float64")
            yield out

    schema = ", ".join([kept, *(f"{v} int" for v in names), *(f"{m} double" for m in measures)])
    return rows.select(*keep, *_flat(fields)).mapInPandas(run, schema)


def judge(rows: DataFrame, keep: list[str], verdict: Callable, name: str) -> DataFrame:
    """The ``keep`` columns of those candidate pairs (``a`` and ``b`` are structs of SIDE) of which ``verdict`` says true or false, and not None, with what it says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            said = pd.Series(list(map(verdict, _sides(df, "a", SIDE), _sides(df, "b", SIDE))), index=df.index, dtype="object")
            said = said[said.notna()]
            yield df.loc[said.index, keep].assign(**{name: said.astype(bool)})

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, *_flat(SIDE)).mapInPandas(run, f"{kept}, {name} boolean")


def _flat(fields: list[str]) -> list[Column]:
    """Flat columns reach the workers as they are; structs would come as one object a row, arrays of words as one array a row."""
    return [(F.array_join(f"{s}.{c}", " ") if c == "common" else F.col(f"{s}.{c}")).alias(f"_{s}_{c}") for s in "ab" for c in fields]


def _sides(df: pd.DataFrame, s: str, fields: list[str]) -> list[Side]:
    blank = [None] * len(df)
    columns = {c: df[f"_{s}_{c}"].tolist() for c in fields}
    if "common" in columns:
        columns["common"] = [w.split(" ") if w else [] for w in columns["common"]]
    return list(map(Side, *(columns.get(c, blank) for c in SIDE)))


def side(prefix: str | None = None):
    """The struct of a parsed record's compared columns."""
    return F.struct(*[F.col(f"{prefix}.{c}" if prefix else c).alias(c) for c in SIDE])
